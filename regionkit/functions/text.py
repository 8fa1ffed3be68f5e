"""Answer and title normalization, token F1, exact match, prompts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode as a character class that all regular expression dialects read alike.
SPACE_CLASS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed values of the answer metrics.
ARTICLES = ("a", "an", "the")
VERDICTS = ("yes", "no", "noanswer")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def normalize_title(title: Column) -> Column:
    """Underscores as blanks, white space squeezed; case stays."""
    return squeeze(F.replace(title, F.lit("_"), F.lit(" ")))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, white space squeezed."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    parts = F.split(F.regexp_replace(bare, r"([^\p{L}\p{N}_]+)", "\x01$1\x01"), "\x01")
    return squeeze(F.array_join(F.transform(parts, lambda p: F.when(p.isin(*ARTICLES), F.lit(" ")).otherwise(p)), ""))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    count = lambda v, t: F.size(F.filter(v, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: as the only element of an array that a lambda goes over."""
    return F.transform(F.array(value), use)[0]


def answer_scores(prediction: Column, gold: Column) -> Column:
    """A struct of em and f1 of the normalized texts, each normalized once.

    f1 is token F1: 1 if both are empty, 0 if one is; yes, no and noanswer only match themselves.
    """

    def score(x: Column) -> Column:
        n, m = F.size(x["a"]), F.size(x["b"])
        exact = (x["p"] == x["g"]).cast("double")
        value = bound(common_tokens(x["a"], x["b"]), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(2.0 * (both / n) * (both / m) / (both / n + both / m)))
        f1 = F.when(x["p"].isin(*VERDICTS) | x["g"].isin(*VERDICTS), exact).when((n == 0) | (m == 0), (n == m).cast("double")).otherwise(value)
        return F.struct(exact.alias("em"), f1.alias("f1"))

    both = F.struct(normalize_answer(prediction).alias("p"), normalize_answer(gold).alias("g"))
    return bound(both, lambda x: bound(F.struct(x["p"].alias("p"), x["g"].alias("g"), tokens(x["p"]).alias("a"), tokens(x["g"]).alias("b")), score))


def f1_score(prediction: Column, gold: Column) -> Column:
    return answer_scores(prediction, gold)["f1"]


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def passage_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" | ", title, text)


def prompt(chunks: Column, question: Column) -> Column:
    """Numbered passages (an array of structs with title and text), then the question."""
    lines = F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["title"], F.lit(") "), c["text"]))
    return F.concat(F.lit("Passages:\n"), F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
