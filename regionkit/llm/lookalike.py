"""One form for texts that look the same: compatibility forms, ignorable characters and look-alike letters.

A text is first brought to compatibility form and freed of ignorable characters. What is left of foreign
letters is settled token by token: each character opens the letters it looks like, and a Viterbi search takes
the path through this lattice that a character n-gram model of the reference names finds most likely, with a
penalty for each change of script inside a token and for each character that is replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism

#: Groups of characters of different scripts that look the same (from Unicode's chart of confusables).
GROUPS = """
aаɑα cсϲᴄ dԁ eе gɡց hһհ iіιı jјϳյ kκк lӏ mᴍм nոη oоοօᴏ pрρ qԛզ rᴦг sѕꜱ uսυᴜ vνѵᴠ wԝωᴡ xхχ yуγ zᴢ tτт bƅЬ
AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ GԌᏀ HНΗᎻ IІΙӀ JЈͿᎫ KКΚᏦK LᏞԼ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ RᏒ SЅՏᏚ TТΤᎢ UՍ VѴᏙ WԜᎳ XХΧ YҮΥУ ZΖᏃ FϜ
ГΓ ПΠ ФΦ ЛΛ фφ вʙ нʜ пπ εє
'’ʼ′‘ʹ -‐‑ .․ ,‚ :∶ /⁄
"""
ALIKE = {c: g for g in GROUPS.split() for c in g}
#: Compatibility forms that read the same; circled, raised or squared forms don't.
SAME = {"<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"}
ORDER = 4
SWITCH, REPLACE, ABSENT = -6.0, -0.7, -9.0


def ignorable(c: str) -> bool:
    n = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc") and not c.isspace() or n in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= n <= 0xFE0F or 0x180B <= n <= 0x180F or 0xE0000 <= n <= 0xE0FFF


@lru_cache(maxsize=20_000)
def script(c: str) -> str:
    """Script of a letter by its Unicode name; empty for what isn't a letter."""
    if not c.isalpha():
        return ""
    return unicodedata.name(unicodedata.normalize("NFD", c)[0], "?").split(" ", 1)[0]


def count_grams(names: Iterable[str]) -> Counter[str]:
    """Character n-grams of the words of names, as written and in capitals."""
    grams: Counter[str] = Counter()
    for name in names:
        for token in (*name.split(" "), *name.upper().split(" ")):
            s = "\x02" * (ORDER - 1) + token + "\x03"
            for n in range(1, ORDER + 1):
                for i in range(max(0, ORDER - n), len(s) - n + 1):
                    grams[s[i : i + n]] += 1
            for n in range(1, ORDER):
                grams["\x02" * n] += 1
    return grams


class Model:
    """Alphabet of the reference names, and character n-grams of their words as written and in capitals."""

    def __init__(self, names: Iterable[str]):
        names = [*names]
        self._fit(count_grams(names), {c for n in names for c in n}, max(map(len, names), default=0))

    @classmethod
    def fitted(cls, grams: list[str], counts: list[int], alphabet: list[str], longest: list[int]) -> Model:
        """The same from what was counted before, as of fitted_on."""
        model = cls.__new__(cls)
        model._fit(Counter(dict(zip(grams, counts))), {*alphabet}, max(longest, default=0))
        return model

    def _fit(self, grams: Counter[str], alphabet: set[str], longest: int) -> None:
        self.longest, self.alphabet, self.grams = longest, alphabet, grams
        self.grams.update(self.alphabet)  # so that a letter that is no word's, as a blank, isn't absent
        #: By foreign script, the ASCII letters that look like one of its letters in the names; other ASCII words need no search.
        self.foreign: dict[str, set[str]] = {}
        for c in self.alphabet:
            if not c.isascii() and (kind := script(c)) not in ("", "LATIN"):
                self.foreign.setdefault(kind, set()).update(x for x in ALIKE.get(c, "") if x.isascii())
        self.total = sum(v for k, v in self.grams.items() if len(k) == 1) or 1
        self.cache: dict[str, str] = {}

    def score(self, history: str, c: str) -> float:
        """Log of the probability of c, from the longest known history; each shortening costs ln 0.4."""
        grams, cost = self.grams, 0.0
        for k in range(len(history)):
            h = history[k:]
            if n := grams.get(h + c):
                return math.log(n / max(grams.get(h, n), n)) + cost
            cost -= 0.92
        n = grams.get(c)
        return (math.log(n / self.total) if n else ABSENT) + cost

    def clean(self, text: str) -> str:
        """Compatibility form without ignorable characters; white space as single blanks; composed."""
        out = []
        for c in unicodedata.normalize("NFC", text):
            if (c in self.alphabet or c in ALIKE) and c != " ":
                out.append(c)
            elif c.isspace():
                out.append(" ")
            elif not ignorable(c):
                form = unicodedata.decomposition(c)
                out.append(unicodedata.normalize("NFKC", c) if form.split(" ", 1)[0] in SAME else c)
        return unicodedata.normalize("NFC", "".join(x for x in "".join(out) if not ignorable(x))).strip(" ")

    def settle(self, token: str) -> str:
        """Viterbi search over the look-alike lattice of one token."""
        if token.isascii():
            letters = {c for c in token if c.isalpha()}
            if not letters or len(token) > self.longest or not any(letters <= like for like in self.foreign.values()):
                return token
        if token in self.cache:
            return self.cache[token]
        cells: list[list[str]] = []
        for c in unicodedata.normalize("NFD", token):
            if unicodedata.combining(c) and cells:
                cells[-1] = [x + c for x in cells[-1]]
            else:
                cells.append([c, *(x for x in ALIKE.get(c, "") if x != c and x in self.alphabet)])
        # each state: its score, and a chain of the letters taken, the last one first
        paths: dict[tuple[str, str], tuple[float, tuple | None]] = {("\x02" * (ORDER - 1), ""): (0.0, None)}
        for cell in cells:
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for k, x in enumerate(cell):
                x = unicodedata.normalize("NFC", x)
                kind = script(x[0])
                for (history, last), (score, path) in paths.items():
                    s = score + (REPLACE if k else 0.0) + (SWITCH if kind and last and kind != last else 0.0)
                    h = history
                    for c in x:
                        s += self.score(h, c)
                        h = (h + c)[-(ORDER - 1) :]
                    state = (h, kind or last)
                    if state not in after or s > after[state][0]:
                        after[state] = (s, (x, path))
            paths = after
        chain = max(((s + self.score(h, "\x03"), i, path) for i, ((h, _), (s, path)) in enumerate(paths.items())), key=lambda x: (x[0], -x[1]), default=(0.0, 0, None))[2]
        taken = []
        while chain:
            taken.append(chain[0])
            chain = chain[1]
        best = "".join(reversed(taken))
        if len(self.cache) < 200_000:
            self.cache[token] = best
        return best

    def one_form(self, text: str) -> str:
        return " ".join(self.settle(t) for t in self.clean(text).split(" "))


#: Names whose n-grams a task counts at a time.
SAMPLE = 200_000


def fitted_on(names: DataFrame, col: str, most: int = SAMPLE) -> tuple[list[str], list[int], list[str], list[int]]:
    """(n-grams, their counts, alphabet, length of the longest) of all names; tasks count `most` names at a time, and the counts are summed."""
    rows = names.select(F.col(col).alias("n")).where("n is not null").distinct()

    def count(batches):
        held: list[str] = []

        def close():
            grams = count_grams(held)
            yield pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], names=["gram", "k"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                held.append(name)
                if len(held) >= most:
                    yield from close()
                    held.clear()
        if held:
            yield from close()

    sums = rows.mapInArrow(count, "gram string, k bigint").groupBy("gram").agg(F.sum("k").alias("k")).toArrow().sort_by("gram")
    letters = rows.select(F.explode(F.array_distinct(F.split("n", ""))).alias("c")).distinct().collect()  # at most Unicode's characters
    longest = rows.agg(F.max(F.length("n"))).first()[0]
    return sums["gram"].to_pylist(), sums["k"].to_pylist(), sorted(r.c for r in letters if r.c), [longest or 0]


_kept: dict[tuple, object] = {}


def kept(make, *what: list):
    """make(*what), kept between the tasks of a Python worker; the last two results are."""
    key = (make.__name__, *(hash(tuple(x)) for x in what))
    if key not in _kept:
        if len(_kept) > 1:
            _kept.clear()
        _kept[key] = make(*what)
    return _kept[key]


def one_form(df: DataFrame, text_col: str, names: DataFrame, name_col: str, form_col: str = "form", most: int = SAMPLE) -> DataFrame:
    """df with form_col, the one form of text_col; null stays null, an empty or invisible text gives "".

    N-grams and alphabet come from all names; every row of df is treated, without a shuffle. Texts in the names' own characters come out as they are, apart from white space, which
    becomes single blanks between words. A form_col already in df is replaced.
    """
    fit = fitted_on(names, name_col, most)

    def run(batches):
        model = kept(Model.fitted, *fit)
        memo: dict[str, str] = {}
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if t is not None and t not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[t] = model.one_form(t)
                out.append(None if t is None else memo[t])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*keep, form_col])

    keep = [c for c in df.columns if c != form_col]
    kinds = dict(df.dtypes)
    return df.select(*[df[c] for c in keep], df[text_col].alias("__t")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{form_col}` string")


def elements(df: DataFrame, tab: str, id_col: Column, array_col: str) -> DataFrame:
    """tab, rec_id, pos, value for each element that isn't null or white space only."""
    out = df.select(F.lit(tab).alias("tab"), id_col.cast("string").alias("rec_id"), F.posexplode(array_col).alias("pos", "value"))
    return out.where(F.regexp_replace("value", r"(?U)[\s\p{Z}]+", "") != "")


def find_lookalikes(values: DataFrame, names: DataFrame, name_col: str, most: int = SAMPLE) -> DataFrame:
    """The distinct rows of values (with a column `value`) that aren't a name, but whose one form is a name; with `form`.

    A list short enough for a broadcast isn't shuffled; the comparison is an equi-join either way.
    """
    known = names.select(F.col(name_col).alias("form")).where("form is not null").distinct()
    open_ = values.join(known, values["value"] == known["form"], "left_anti").repartition(parallelism(values.sparkSession, values), *values.columns).dropDuplicates()  # one shuffle for both
    return one_form(open_, "value", names, name_col, most=most).join(known, "form").select(*values.columns, "form")
