"""Entry of a reference list that a freely typed value stands for.

A multi-pattern automaton over the names and their aliases finds mentions in the value; the longest mentions
that don't overlap count, and the value stands for the entry if nothing but filler is left beside one of them.
Other values go to token-set similarity, in which two tokens may agree up to a slip of the keyboard.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from urllib.parse import unquote_plus

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .lookalike import Model, kept

#: Usual short forms of words in names, and words beside a name that don't change what it names.
SHORT = {"univ": "university", "co": "company", "st": "saint", "mt": "mount", "ft": "fort", "№": "no", "nr": "no", "&": "and", "+": "and"}
FILLER = {"the", "a", "an", "ed", "page", "article", "wiki", "see", "also", "title", "entry"}
NOTE = re.compile(r"\s*\[(?:\d+|ed\.?|sic|note|citation needed)\]", re.I)
BRACKET = re.compile(r"(.*\S)\s*\([^()]+\)$")
ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
WORD = re.compile(r"№|²|\d+|[^\W\d_]+(?:['’][^\W\d_]+)*", re.U)


def distance(a: str, b: str, most: int) -> int:
    """Letters inserted, left out, replaced, or exchanged with their neighbours to turn a into b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[-1], most + 1)


def slips(word: str) -> int:
    """How many slips a word of this length may have."""
    return 0 if len(word) < 3 or word.isdigit() else 1 if len(word) < 6 else 2 if len(word) < 8 else 3


def shorter(word: str, by: int = 1) -> set[str]:
    """The word and what is left of it without up to `by` letters."""
    out = {word}
    for _ in range(by):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def halves(word: str, cuts: range) -> set[str]:
    """Beginnings and ends of the word up to each cut, and what is left of them without one letter.

    Of a word with three slips one half has one at most. A cut may fall between two exchanged letters; the next one doesn't.
    """
    out = set()
    for c in cuts:
        out |= {"<" + x for x in shorter(word[:c])} | {">" + x for x in shorter(word[c:])}
    return out


class Matcher:
    def __init__(self, entries: list[tuple[int, str]]):
        self.exact = {t: i for i, t in entries}
        self.model = Model(self.exact)
        self.memo: dict[str, int] = {}
        keys: dict[str, set[int]] = defaultdict(set)
        joined: dict[str, set[int]] = defaultdict(set)
        self.words: dict[int, tuple[str, ...]] = {}
        alias: dict[str, set[int]] = defaultdict(set)
        for i, t in entries:
            w = self.tokens(t)
            self.words[i] = w
            if not w:
                continue
            keys[" ".join(w)].add(i)
            joined["".join(w)].add(i)
            forms = {(*w[1:], w[0]), (w[-1], *w[:-1])} if len(w) > 1 else set()
            if w[0] == "the":
                forms |= {w[1:], (*w[1:], "the")}
            if bare := BRACKET.match(t):
                forms.add(self.tokens(bare[1]))  # stands for the entry if it is the only one of that name
            for f in forms:
                if f:
                    alias[" ".join(f)].add(i)
                    joined["".join(f)].add(i)
        for k, v in alias.items():
            if k not in keys:
                keys[k] |= v
        self.joined = {k: next(iter(v)) for k, v in joined.items() if len(v) == 1}
        self.automaton = ahocorasick.Automaton()
        for k, v in keys.items():
            self.automaton.add_word(f" {k} ", (len(k), next(iter(v)) if len(v) == 1 else -1))
        if keys:
            self.automaton.make_automaton()
        counts = Counter(x for w in self.words.values() for x in set(w))
        self.known = set(counts)
        self.common: dict[str, list[str]] = defaultdict(list)  # by their first letter
        for x in sorted(x for x, n in counts.items() if n >= 10 and len(x) > 3):
            self.common[x[0]].append(x)
        self.near: dict[str, set[int]] = defaultdict(set)  # by a joined name without up to one letter
        self.rare: dict[str, set[int]] = defaultdict(set)  # by a rare word without up to two letters
        for k, v in joined.items():
            if len(k) > 3:
                for x in shorter(k):
                    self.near[x] |= v
        self.long: dict[str, set[int]] = defaultdict(set)  # by a rare word that may have three slips
        self.half: dict[str, set[str]] = defaultdict(set)  # such words by their halves
        for i, w in self.words.items():
            may = [x for x in w if slips(x)]
            # an entry of frequent words only has the rarest as its key
            keyed = {x for x in may if counts[x] < 50} or set(sorted(may, key=lambda x: (counts[x], x))[:1])
            for x in w:
                if x in keyed:
                    for y in shorter(x, min(2, slips(x))):
                        self.rare[y].add(i)
                    if slips(x) > 2:
                        self.long[x].add(i)
        self.longest = max(map(len, self.long), default=0)
        for x in self.long:
            for y in halves(x, range(len(x) // 2, len(x) // 2 + 2)):
                self.half[y].add(x)

    def tokens(self, text: str) -> tuple[str, ...]:
        text = unicodedata.normalize("NFC", text.casefold())
        words = [x.replace("'", "").replace("’", "") for x in WORD.findall(text.replace("&", " and "))]
        return tuple(SHORT.get(x, x) for x in words)

    def plain(self, value: str) -> tuple[str, str]:
        """Without escapes, notes, and the marks of lists and quotations: as typed, and with look-alike letters settled."""
        if ESCAPED.search(value):
            value = unquote_plus(value)
        value = html.unescape(value).replace("_", " ")
        value = NOTE.sub("", self.model.clean(value)).strip(" *\"“”„'`.,;:?!-–—…·#>")
        return value, self.model.one_form(value)

    def mentions(self, words: tuple[str, ...]) -> tuple[set[int], int]:
        """Entries of the longest mentions that don't overlap, and the number of words beside them that are no filler."""
        text = " " + " ".join(words) + " "
        if not len(self.automaton):
            return set(), len(words)
        found = sorted(((size, end, i) for end, (size, i) in self.automaton.iter(text)), key=lambda x: (-x[0], x[1]))
        taken, ids = [False] * len(text), set()
        for size, end, i in found:
            start = end - size
            if not any(taken[start:end]):
                taken[start:end] = [True] * size
                ids.add(i)
        left = "".join(" " if t else c for c, t in zip(text, taken)).split()
        return ids, sum(x not in FILLER for x in left)

    def whole(self, word: str) -> str:
        """The frequent word of the list that `word` shortens, if there is one and only one."""
        if word in self.known or len(word) < 3 or word.isdigit():
            return word
        near = self.common.get(word[0], ())
        found = [x for x in near if x.startswith(word)]
        if not found:
            found = [x for x in near if x[-1] == word[-1] and len(x) > len(word) and self.within(word, x)]
        return found[0] if len(found) == 1 else word

    @staticmethod
    def within(short: str, long: str) -> bool:
        at = iter(long)
        return all(c in at for c in short)

    def apart(self, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        """Slips that make the token sets of a and b agree; infinite if they can't."""
        x, y = Counter(a), Counter(b)
        rest_x, rest_y = list((x - y).elements()), list((y - x).elements())
        for rest in (rest_x, rest_y):
            if "the" in rest and len(rest_x) != len(rest_y):
                rest.remove("the")
        if len(rest_x) != len(rest_y) or len(rest_x) > 3:
            return math.inf
        total = 0
        for p in rest_x:
            d, q = min(((distance(p, q, min(slips(p) or 0, slips(q) or 0)), q) for q in rest_y), default=(9, ""))
            if not q or d > min(slips(p), slips(q)):
                return math.inf
            rest_y.remove(q)
            total += d
        return total

    def similar(self, words: tuple[str, ...]) -> int:
        """The one entry with the same token set up to three slips in all, two of them in words under eight letters; -1 if there is none or several are as near."""
        joined = "".join(words)
        numbers = re.findall(r"\d+", joined)
        ids: set[int] = set()
        for x in words:
            if slips(x):
                for k in shorter(x, min(2, slips(x))):
                    ids |= self.rare.get(k, set())
        near: dict[int, float] = {i: self.apart(words, self.words[i]) for i in ids}
        for k in shorter(joined):
            for i in self.near.get(k, ()):
                w = self.words[i]
                forms = {"".join(w), "".join((*w[1:], w[0])), "".join((w[-1], *w[:-1])), "".join(w[w[0] == "the" :])}
                if min(distance(joined, f, 1) for f in forms) <= 1 and sorted(numbers) == sorted(re.findall(r"\d+", "".join(w))):
                    near[i] = min(near.get(i, math.inf), 1.0)
        if min(near.values(), default=3) >= 3:
            for x in words:
                if slips(x) > 2 and len(x) <= self.longest + 3:
                    met = set().union(*(self.half.get(k, ()) for k in halves(x, range(2, len(x) - 1))))
                    for i in {i for y in met if abs(len(x) - len(y)) <= 3 and distance(x, y, 3) <= 3 for i in self.long[y]} - near.keys():
                        near[i] = self.apart(words, self.words[i])
        near = {i: d for i, d in near.items() if d <= 3}
        if not near:
            return -1
        best = min(near.values())
        kept = [i for i, d in near.items() if d == best]
        return kept[0] if len(kept) == 1 else -1

    def find(self, value: str) -> int:
        """Number of the entry that value stands for, or -1."""
        if value in self.exact:
            return self.exact[value]
        if value not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[value] = self.search(value)
        return self.memo[value]

    def search(self, value: str) -> int:
        raw, plain = self.plain(value)
        if (out := self.exact.get(plain, -1)) >= 0:
            return out
        forms = [*dict.fromkeys(self.tokens(x) for x in (plain, raw, self.model.one_form(raw.casefold())))]
        forms = [w for w in forms if w]
        for w in forms:
            ids, left = self.mentions(w)
            if len(ids) == 1 and not left and -1 not in ids:
                return ids.pop()
            core = w[1:] if w[0] == "the" else w
            if (out := self.joined.get("".join(w), self.joined.get("".join(core), -1))) >= 0:
                return out
        for w in forms:
            full = tuple(self.whole(x) for x in w)
            if full != w:
                ids, left = self.mentions(full)
                if len(ids) == 1 and not left and -1 not in ids:
                    return ids.pop()
            for x in dict.fromkeys((w, full)):
                if (out := self.similar(x)) >= 0:
                    return out
        return -1


def map_to_list(values: DataFrame, entries: DataFrame, id_col: str, name_col: str, max_entries: int = 200_000) -> DataFrame:
    """values (with a column `value`) and `title_id`, the entry each value stands for, or -1; duplicates removed first.

    Null values, and values of white space only, stand for nothing: -1. Of entries with the same name the smallest
    id counts; null names are left out; an empty list gives -1 throughout. The list goes to every task, so
    it may hold at most max_entries rows (it is a reference list that doesn't grow with the data); more raise an
    error rather than lose entries. Values are mapped where they lie, without a shuffle by value, so that a value
    shared by a third of all rows is no hot spot; each worker keeps the answers to the values it has seen.
    """
    rows = entries.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("n")).agg(F.min(id_col).alias("i")).limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries")
    fit = sorted((r.i, r.n) for r in rows)
    keep = [c for c in values.columns if c != "title_id"]
    at = keep.index("value")

    def run(batches):
        matcher = kept(Matcher, fit)
        for batch in batches:
            ids = [-1 if v is None or not v.strip() else matcher.find(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32())], names=[*keep, "title_id"])

    kinds = dict(values.dtypes)
    dealt = values.select(*keep).repartition(parallelism(values.sparkSession, values), *keep).dropDuplicates()  # one shuffle for both
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", title_id int")
