"""Records of evaluation splits that occur again in the training split, exactly or altered without change of sense.

Each text is brought to one form (look-alike characters, case, punctuation, white space) and its tokens are told
apart: names of the reference list, numbers and other rare words say what is asked about; the words that many
texts share, slips of them, and framing only say how. Hashes of the canonical record are joined between the splits:
of the id, of the whole form, and of the sequence of names, numbers and rare words. Pairs that meet by the last
are checked exactly. A record that names fewer than two things is told from others by its wording alone: its words
without framing, slips put right, are hashed instead.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .lookalike import SAMPLE, Model, fitted_on, kept
from .titles import distance, shorter

TOKEN = re.compile(r"\d+|[^\W\d_]+(?:['’][^\W\d_]+)*|²|№")
NUMBERING = re.compile(r"^\s*(?:[(\[][^)\]]{1,25}[)\]]|#?\s*(?:q(?:uestion)?\s*)?\d{1,3}\s*[.):\]]|(?:q|question)\s*:)\s+", re.I)
TAIL = re.compile(r"\s*(?:\[[^\]]{1,25}\]|\((?=[^)]*[\s\d])[^)]{1,30}\))\s*[.?!]*\s*$")
#: Words around a question that don't change it.
FRAMING = frozenset("a an the hey hi hello please thanks thank you question answer q explain briefly short one only just tell me multi hop could can quick so ok okay dear kindly help need i know want to would like".split())


class Reader:
    """Canonical form of a text, and what it is about."""

    def __init__(self, grams: list[str], counts: list[int], alphabet: list[str], longest: list[int], names: list[str], common: list[str]):
        """grams, counts, alphabet and longest as of lookalike.fitted_on; names as keys (canonical_name), which are looked for in the texts; common wording."""
        self.model = Model.fitted(grams, counts, alphabet, longest)
        self.common = frozenset(common)
        self.near: dict[str, list[str]] = {}
        for w in common:
            if len(w) > 3:
                for k in shorter(w):
                    self.near.setdefault(k, []).append(w)
        self.names = ahocorasick.Automaton()
        for key in names:
            self.names.add_word(f" {key} ", (key.count(" ") + 1, len(key) + 2))
        if len(self.names):
            self.names.make_automaton()

    @staticmethod
    def words(text: str) -> list[str]:
        return [w.replace("’", "'") for w in TOKEN.findall(unicodedata.normalize("NFC", text).casefold())]

    def form(self, text: str) -> tuple[list[str], list[str], bool]:
        """Tokens of the text without numbering and tail: as written, and in lower case; and whether it has capitals."""
        text = self.model.one_form(text)
        while (cut := TAIL.sub("", NUMBERING.sub("", text))) != text and cut:
            text = cut
        raw = [w.replace("’", "'") for w in TOKEN.findall(text)]
        tokens = self.words(text)
        return raw if len(raw) == len(tokens) else tokens, tokens, not text.islower() and not text.isupper()

    def read(self, text: str, spans: list[tuple[int, int]] | None = None) -> tuple[str, str | None, str | None, list[str]]:
        """Canonical form, two sequences of what the text names, of which the second leaves out likely slips and wording, and
        forms without framing if either names fewer than two things. spans: places and lengths of the names among the
        tokens, if they were looked for elsewhere."""
        raw, tokens, cased = self.form(text)
        capital = [not cased or w[0].isupper() for w in raw]
        taken = self.longest([(n, i) for i, n in spans] if spans is not None else self.spans(tokens))
        strict, loose = self.about(tokens, capital, cased, taken)
        plain = self.unframed(tokens, [cased and i > 0 and c for i, c in enumerate(capital)], taken) if min(len(strict), len(loose)) < 2 else []
        return " ".join(tokens), " ".join(strict) if len(strict) > 1 else None, " ".join(loose) if len(loose) > 1 else None, plain

    def unframed(self, tokens: list[str], fixed: list[bool], taken: dict[int, int]) -> list[str]:
        """The words in their order without framing: as they are, with slips of common words put right, and with one other
        word of the wording short of a letter, as two slips of one word meet. Names and numbers, also those in `fixed`, stay."""
        taken = {j for k, n in taken.items() for j in range(k, k + n)}
        at = [i for i, t in enumerate(tokens) if i in taken or t not in FRAMING]
        if not at:
            return []
        words = [tokens[i] for i in at]
        free = [i not in taken and not fixed[i] and not tokens[i].isdigit() and tokens[i] not in self.common for i in at]
        right = [self.right(w) if f else w for w, f in zip(words, free)]
        out = {" ".join(words), " ".join(right)}
        for i, w in enumerate(right):
            if free[i] and w == words[i] and len(w) > 3:
                out |= {" ".join((*right[:i], x, *right[i + 1 :])) for x in shorter(w)}
        return sorted(out)

    def right(self, word: str) -> str:
        """The common word that `word` is a slip of, if there is one and only one."""
        near = {w for k in shorter(word) for w in self.near.get(k, ()) if distance(word, w, 1) <= 1} if len(word) > 2 else set()
        return near.pop() if len(near) == 1 else word

    def slip(self, word: str) -> bool:
        """Whether the word is a slip of a common one: one letter too many, too few, wrong, or two exchanged."""
        return len(word) > 2 and any(distance(word, w, 1) <= 1 for k in shorter(word) for w in self.near.get(k, ()))

    def spans(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Length and place of every name among the tokens."""
        if not len(self.names):
            return []
        text, at, pos = " " + " ".join(tokens) + " ", {}, 0
        for i, t in enumerate(tokens):
            at[pos] = i
            pos += len(t) + 1
        return [(n, at[end - length + 1]) for end, (n, length) in self.names.iter(text)]

    @staticmethod
    def longest(spans: list[tuple[int, int]]) -> dict[int, int]:
        """Lengths by place of the longest names that don't overlap."""
        used, taken = set(), {}
        for n, i in sorted(spans, key=lambda x: (-x[0], x[1])):
            if used.isdisjoint(range(i, i + n)):
                used.update(range(i, i + n))
                taken[i] = n
        return taken

    def about(self, tokens: list[str], capital: list[bool], cased: bool, taken: dict[int, int]) -> tuple[list[str], list[str]]:
        """What the tokens name; names joined by and/or are put in order, since they can change places."""
        # words that may be names; persons have two, so that one alone in a text without capitals, or at the start, is wording
        new = [c and not t.isdigit() and t not in self.common and t not in FRAMING for t, c in zip(tokens, capital)]
        ends = {k + n - 1 for k, n in taken.items()}
        strict: list[str] = []
        loose: list[str] = []
        i, last = 0, -9  # last: where the last name of the list ended
        while i < len(tokens):
            t = tokens[i]
            if i in taken:
                n = taken[i]
                key = "#" + "_".join(tokens[i : i + n])
                swap = last == i - 1 and tokens[last] in ("and", "or") and strict and strict[-1] > key
                for out in (strict, loose):
                    out.insert(len(out) - 1 if swap else len(out), key)
                i += n
                last = i
                continue
            if t.isdigit():
                strict.append(t)
                loose.append(t)
            elif new[i]:
                strict.append(t)
                alone = not (i and (i - 1) not in ends and new[i - 1]) and not (i + 1 < len(tokens) and (i + 1) not in taken and new[i + 1])
                if not ((not cased or not i) and (alone or self.slip(t))):
                    loose.append(t)
            i += 1
        return strict, loose


def common_words(df: DataFrame, text_col: str, share: float = 1 / 40_000) -> list[str]:
    """Words of wording rather than names: at least two texts with capitals, and this share of them, write them without, or 0.3% begin with them.

    As a text has few words, the share bounds their number, however large df is.
    """
    t = F.col(text_col)
    cased = df.where((F.lower(t) != t) & (F.upper(t) != t)).select(t.alias("t"))
    inner = F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{N}'’])(\p{Ll}+)(?![\p{L}'’])"), 1))
    first = F.lower(F.regexp_extract("t", r"^[^\p{L}]*(\p{L}+)", 1))
    seen = cased.select(F.explode(F.transform(inner, lambda w: F.struct(w.alias("w"), F.lit(False).alias("first")))).alias("x")).unionAll(cased.select(F.struct(first.alias("w"), F.lit(True).alias("first")).alias("x"))).select("x.*")
    counts = seen.groupBy("w").agg(F.count_if(~F.col("first")).alias("inner"), F.count_if("first").alias("first"))
    n = cased.count()
    rows = counts.where((F.col("w") != "") & ((F.col("inner") >= max(2.0, share * n)) | (F.col("first") >= max(3.0, 0.003 * n)))).collect()
    return sorted(r.w for r in rows)


def canonical_name(names: DataFrame, col: str) -> DataFrame:
    """key: distinct names as they are looked for in texts, in lower case without punctuation."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(Reader.words(n)) for n in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return names.select(F.col(col).alias("n")).where("n is not null").mapInArrow(run, "key string").where("key <> ''").distinct()


def named_spans(texts: DataFrame, keys: DataFrame, fit: tuple[list[str], list[int], list[str], list[int]]) -> DataFrame:
    """text, spans: places and lengths of the names in each distinct text, by a join of word sequences with the names' keys."""
    longest = keys.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1

    def forms(batches):
        for batch in batches:
            reader = kept(Reader, *fit, [], [])
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.form(t)[1] for t in texts], pa.list_(pa.string()))], names=["text", "w"])

    each = texts.select("text").distinct().mapInArrow(forms, "text string, w array<string>").select("text", "w", F.posexplode("w").alias("i", "_"))
    each = each.select("text", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i")))).alias("n"))
    met = each.select("text", "i", "n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("key")).join(keys, "key")
    return met.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("spans"))


def _read(df: DataFrame, rec_col: str, split_col: str, id_col: str, text_col: str, names: DataFrame, name_col: str, train: str, most_names: int, sample: int) -> DataFrame:
    """rec, is_train, id, form, its class, and keys of every record; written once."""
    fit = fitted_on(names, name_col, sample)
    common = common_words(df, text_col)
    keys = canonical_name(names, name_col)
    short = sorted(r.key for r in keys.limit(most_names + 1).collect())
    src = df.select(df[rec_col].alias("rec"), (df[split_col] == train).alias("is_train"), df[id_col].cast("string").alias("id"), df[text_col].alias("text"))
    src = spread(src.where("rec is not null and is_train is not null and text is not null"))
    if joined := len(short) > most_names:  # too many to go to every task
        short = []
        src = src.join(named_spans(src, keys, fit), "text", "left").select("rec", "is_train", "id", "text", F.coalesce("spans", F.array().cast("array<struct<i:int,n:int>>")).alias("spans"))

    def read(batches):
        reader = kept(Reader, *fit, short, common)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            spans = [[(x["i"], x["n"]) for x in s] for s in batch.column(4).to_pylist()] if joined else [None] * len(texts)
            out = [reader.read(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in out], pa.string()) for k in range(3)), pa.array([r[3] for r in out], pa.list_(pa.string()))], names=["rec", "is_train", "id", "form", "strict", "loose", "plain"])

    kind = dict(df.dtypes)[rec_col]
    rows = src.mapInArrow(read, f"rec {kind}, is_train boolean, id string, form string, strict string, loose string, plain array<string>").where("form <> ''")
    return cut_lineage(rows.withColumn("class", F.md5("form")))


def _links(rows: DataFrame) -> DataFrame:
    """ca, cb: pairs of classes of equal forms, of a training and another record, that ask the same; a class with itself included."""
    # one row for each class and side on which it occurs; keys depend on capitals, which forms have lost
    classes = rows.groupBy("class", "is_train").agg(F.min("form").alias("form"), F.collect_set("strict").alias("strict"), F.collect_set("loose").alias("loose"), F.array_distinct(F.flatten(F.collect_set("plain"))).alias("plain"))
    keys = classes.select("class", "is_train", "form", F.explode(F.array_union("strict", "loose")).alias("key")).withColumn("key", F.xxhash64("key"))
    a = keys.where("is_train").select(F.col("class").alias("ca"), F.col("form").alias("fa"), "key")
    b = keys.where("not is_train").select(F.col("class").alias("cb"), F.col("form").alias("fb"), "key")
    x, y = F.array_distinct(F.split("fa", " ")), F.array_distinct(F.split("fb", " "))
    same = F.size(F.array_intersect(x, y)) >= 0.5 * F.greatest(F.size(x), F.size(y))
    met = a.join(b, "key").where("ca <> cb").where(same).select("ca", "cb")
    plain = classes.select("class", "is_train", F.explode("plain").alias("key")).withColumn("key", F.md5("key"))
    worded = plain.where("is_train").select(F.col("class").alias("ca"), "key").join(plain.where("not is_train").select(F.col("class").alias("cb"), "key"), "key").where("ca <> cb").select("ca", "cb")
    own = classes.groupBy("class").agg(F.count("*").alias("n")).where("n = 2").select(F.col("class").alias("ca"), F.col("class").alias("cb"))
    return met.unionByName(worded).distinct().unionByName(own)


def cross_split_overlaps(df: DataFrame, rec_col: str, split_col: str, id_col: str, text_col: str, names: DataFrame, name_col: str, train: str = "train", most_names: int = 200_000, sample: int = SAMPLE) -> DataFrame:
    """Distinct pairs (rec_a, rec_b), rec_a < rec_b, of one training and one other row that ask the same.

    Same id, same form, or same sequence of names, numbers and rare words in wording that otherwise agrees by half; of
    records that name fewer than two things, same words but for framing and slips.
    Null ids meet nothing; texts that are null or have no letter or digit meet nothing, not even by id; rows with a
    null split or record number are left out. Equal forms are one class: classes are compared, not rows, and only
    at the end is each pair of classes expanded to its records, as the result asks for; overlap_counts doesn't. Up to
    most_names names go to every task; more are found by a join. The n-grams of lookalike are counted on all names, sample names at a time.
    """
    rows = _read(df, rec_col, split_col, id_col, text_col, names, name_col, train, most_names, sample)
    ta = rows.where("is_train").select(F.col("class").alias("ca"), F.col("rec").alias("ra"))
    tb = rows.where("not is_train").select(F.col("class").alias("cb"), F.col("rec").alias("rb"))
    pairs = _links(rows).join(ta, "ca").join(tb, "cb").select("ra", "rb")
    by_id = rows.where("id is not null").select("id", "rec", "is_train")
    pairs = pairs.unionByName(by_id.where("is_train").select("id", F.col("rec").alias("ra")).join(by_id.where("not is_train").select("id", F.col("rec").alias("rb")), "id").select("ra", "rb"))
    return pairs.distinct().select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))


def overlap_counts(df: DataFrame, rec_col: str, split_col: str, id_col: str, text_col: str, names: DataFrame, name_col: str, train: str = "train", most_names: int = 200_000, sample: int = SAMPLE) -> DataFrame:
    """rec, class, links: every evaluation record with the class of its form and the number of training records that ask the same.

    The same overlaps as cross_split_overlaps, counted without expanding them: training records are summed by class, by id, and
    by both, since a record may be met by its class as well as by its id. Record numbers must be unique.
    """
    rows = _read(df, rec_col, split_col, id_col, text_col, names, name_col, train, most_names, sample)
    links = cut_lineage(_links(rows))
    seen, asked = rows.where("is_train"), rows.where("not is_train").select("rec", "class", "id")
    by_class = links.join(seen.groupBy(F.col("class").alias("ca")).agg(F.count("*").alias("n")), "ca").groupBy(F.col("cb").alias("class")).agg(F.sum("n").alias("by_class"))
    by_id = seen.where("id is not null").groupBy("id").agg(F.count("*").alias("by_id"))
    # pairs of an id and a class among the evaluation records, and how many training records they meet by both
    both = asked.where("id is not null").select("id", F.col("class").alias("cb")).distinct().join(links, "cb")
    both = both.join(seen.groupBy("id", F.col("class").alias("ca")).agg(F.count("*").alias("n")), ["id", "ca"]).groupBy("id", F.col("cb").alias("class")).agg(F.sum("n").alias("by_both"))
    out = asked.join(by_class, "class", "left").join(by_id, "id", "left").join(both, ["id", "class"], "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    return out.select("rec", "class", (of("by_class") + of("by_id") - of("by_both")).alias("links"))


def overlap_report(counts: DataFrame, df: DataFrame, rec_col: str, split_col: str, source_col: str) -> DataFrame:
    """split, source, records (of this split and source with a partner in training) and pairs; a null source stays null."""
    ev = df.select(F.col(rec_col).alias("rec"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return counts.where("links > 0").join(ev, "rec").groupBy("split", "source").agg(F.count("*").alias("records"), F.sum("links").alias("pairs"))
