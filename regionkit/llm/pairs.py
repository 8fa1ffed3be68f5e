"""Kind of defect of a prompt and response pair.

empty, copied_question, refusal, truncated and other_language are looked for in this order; a pair has the first
that applies. Copies are found by compressing the response with the prompt as a zstandard dictionary, and the question
with the response as one; refusals and languages by dictionaries; truncation by a terminal-context model: how often the
last tokens of a response (names and numbers masked) end responses in the whole corpus, against how often they occur in
it, and whether the last word is a word at all, or the beginning of one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .refusals import declines

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in and or was is are were by for with from at as on that which who it its this but not only had has have did does be been he she they them their there when since before after because therefore answer never both while later first says no yes",
    "de": "der die das den dem des ein eine einen einem und oder ist war waren wurde wurden werden wird nicht aber nur nach von vom zu zum zur im in mit auf für aus weil wohl zuerst hat haben dort es er sie ich kann keine kein sich als auch laut seit wer beide erst später mehr zurück jahr antwort",
    "fr": "le la les l un une des du de d et ou est était été a qui que qu quoi ne pas plus y il elle ils c n s seul mais car pour par sur dans au aux en ce cette ces depuis avant premier deuxième réponse déjà tard cause je sont avait soit parti",
    "es": "el la los las un una unos de del y o es era fue que quien no se lo su al en por para con pero solo porque desde después primero según allí dos estaba a aunque nadie quién respuesta cerrado más había sé",
    "ru": "и в во не на но что кто он она оно они был была было были это его её их из за с со у от до по а только потому после снова там хотя никто оба ответ году года первым ему я этот или как для согласно",
    "it": "il lo gli un una e è era che di del della non per con ma solo perché dopo prima nel al si chi sono stato come",
    "pt": "o os um uma e é era foi que de do da não se por para com mas só porque depois desde quem em no na ao são como",
    "nl": "de het een en of is was niet maar van voor met op dat die wie werd zijn haar er in naar door te ook alleen omdat eerst",
    "pl": "i w nie na to że był była jest się z do po ale który która tylko kto przed jako przez dla",
    "sv": "och det som en ett är var inte men av för med på till den att från vem efter bara",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Words after which no sentence ends.
DANGLING = frozenset(
    "the a an of to in and or by for with from at on that which who whom whose was were is are be been but because since although while when where if than as into its their his her had has "
    "der die das den dem des ein eine einen einem und oder von vom zu zum zur im mit auf für aus weil aber nur ist "
    "le la les un une des du de et ou est que qui mais car pour par sur dans au aux en "
    "el los las una del y o es que pero porque por para con su al "
    "и в во на но что из за с со у от до по а потому или".split()
)
END = re.compile(r"[.!?…。！？]['\"’”»)\]）」]*$")
TOKEN = re.compile(r"\d+(?:st|nd|rd|th)?|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]")
LOWER = re.compile(r"(?<![^\W_])[^\W\d_A-Z]+(?![^\W_])")
KANA = re.compile("[぀-ヿ]")
CJK = re.compile("[぀-ヿ一-鿿]")
LABELS = {"question", "answer", "q", "a"}


def question_of(prompt: str | None) -> str:
    """What stands between the last Question: and the Answer: behind it."""
    if not prompt:
        return ""
    at = prompt.rfind("Question:")
    q = prompt[at + 9 :] if at >= 0 else prompt
    end = q.rfind("Answer:")
    return (q[:end] if end >= 0 else q).strip()


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold())


def compressed(text: bytes, dictionary: bytes) -> int:
    """Bytes of text compressed with a raw dictionary, without checksum and sizes."""
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=19, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text))


#: Bytes that a response may add to the prompt (a copy adds none; one that leaves words out, a few for each gap), and that the
#: question may add to the response, by the bytes of the question.
ADDED, ADDED_BY_GAPS, LEFT_OUT = 1, 7, 0.3


def copies(answer: str, prompt: str | None) -> bool:
    """Whether the response says the question again and nothing else.

    With the prompt as dictionary, at the end of which the question stands three times, a response that only says the question
    compresses to what the question, said as often, compresses to; one that adds words takes more. With the response as
    dictionary the question must compress as well, which tells copies of the question from other text of the prompt.
    """
    a, q = ([w for w in words_of(x) if w not in LABELS] for x in (answer, question_of(prompt)))
    if len(q) < 3 or len(a) < 0.75 * len(q):
        return False
    said, asked = " ".join(a).encode(), " ".join(q).encode()
    if len(said) < 8 or len(asked) < 8:
        return said == asked
    least = compressed(asked, asked)
    if compressed(asked, said) - least > LEFT_OUT * len(asked):
        return False
    shown = " ".join(words_of((prompt or "")[: (prompt or "").rfind("Question:") + 1])).encode()
    known = shown + b" " + asked + b" " + asked + b" " + asked
    again = b" ".join([asked] * max(1, round(len(said) / len(asked))))
    return compressed(said, known) - compressed(again, known) <= (ADDED if len(said) >= len(asked) else ADDED_BY_GAPS)


def masked(text: str) -> list[str]:
    """Tokens with numbers as 9 and names as N; words of sentences in lower case."""
    out: list[str] = []
    for t in TOKEN.findall(CJK.sub("N", text)):
        low = t.casefold()
        if t[0].isdigit():
            m = "9" if t.isdigit() else "9th"
        elif t[0].isalpha() and (t[0].isupper() or not t[0].islower()):
            known = any(low in w for w in WORDS.values())
            m = low if known and (not out or out[-1] in (".", "?", "!", ":")) and t[1:].islower() | (len(t) == 1) else "N"
        else:
            m = low
        if m == "N" and out:
            if out[-1] in ("N", "9", "the"):
                out[-1] = "N"
                continue
            if len(out) > 1 and out[-2] == "N" and out[-1] in ("of", "and", "-", "№", "'"):
                del out[-1]
                continue
        if m == "9" and out and out[-1] == "N":
            continue
        if m == ")" and len(out) > 2 and out[-2] == "(" and out[-3] == "N":
            del out[-2:]
            continue
        if m in ("²", "№") and out and out[-1] == "N":
            continue
        out.append(m)
    return out


def language(text: str) -> tuple[str, int]:
    """Most likely language by function words outside names, and the number of words that speak for it."""
    if len(KANA.findall(text)) >= 3:
        return "ja", len(KANA.findall(text))
    hits: Counter[str] = Counter()
    for w in masked(text.replace("’", "'")):
        for x in w.split("'"):
            for k, v in WORDS.items():
                if x in v:
                    hits[k] += 1
    if not hits:
        return "", 0
    (first, n), *rest = hits.most_common(2)
    return (first, n) if not rest or rest[0][1] < n else ("", n)


def contexts(text: str) -> list[list[str]]:
    """For each token, its contexts from the longest (with three tokens before it) to the token alone."""
    t = ["<", *masked(text)]
    return [[" ".join(t[max(0, i - n) : i + 1]) for n in range(min(i, 3), -1, -1)] for i in range(1, len(t))]


def end_keys(text: str) -> list[str]:
    """The longest context of the last token; in longer texts also the shorter ones, and the one of the token before it."""
    c = contexts(text)
    if len(c) <= 5:
        return c[-1][:1]
    return [k for k in c[-1] if k not in ("N", "9")] + c[-2][:1]


def has_word(text: str) -> bool:
    return any(c.isalnum() for c in text)


def first_look(prompt: str | None, answer: str | None) -> tuple[str, list[str]]:
    """The defect or "", and the keys of the end if it must be judged by the model."""
    if answer is None or not has_word(answer):
        return "empty", []
    if copies(answer, prompt):
        return "copied_question", []
    text = answer.strip()
    if declines(text):
        return "refusal", []
    if text.count("(") > text.count(")"):
        return "truncated", []
    if not END.search(text):
        tokens = masked(text)
        if tokens and (tokens[-1] in DANGLING and len(tokens) > 1 or tokens[-1] in (*",;:–—-(&", "9th")):
            return "truncated", []
        if len(KANA.findall(text)) >= 3 or half_a_name(text, prompt):
            return "truncated", []
        if len(tokens) > 1:
            word = tokens[-1] if tokens[-1].isalpha() and tokens[-1].islower() else ""
            return "", [KNOWN + word, BEGUN + word, *end_keys(text)] if word else end_keys(text)
    return "", []


#: Marks of the keys that say that a word occurs in prompts or inside responses, and that such a word begins so.
KNOWN, BEGUN = "w:", "p:"


def half_a_name(text: str, prompt: str | None) -> bool:
    """Whether the text ends in a capitalised word that isn't in the prompt, but begins a word of it."""
    last = re.search(r"[^\W\d_]+$", text)
    if not last or not prompt or not last[0][0].isupper():
        return False
    places = [m.end() for m in re.finditer(r"(?<![^\W\d_])" + re.escape(last[0]), prompt)]
    return bool(places) and all(p < len(prompt) and prompt[p].isalpha() for p in places)


def speaks_other(prompt: str | None, answer: str | None) -> bool:
    """A sentence in another language than the question: at least two function words, and a language for either."""
    if not answer:
        return False
    asked, n = language(question_of(prompt))
    said, m = language(answer)
    return bool(asked and said and asked != said and n >= 2 and m >= 2)


def find_defects(df: DataFrame, id_col: str, prompt_col: str, answer_col: str, least_rate: float = 0.13, least_seen: int = 5) -> DataFrame:
    """Distinct (id_col, defect) of the defective pairs; a good pair gives no row.

    Null or blank answers, and those without a letter or digit, are empty. A null prompt has no question: such an
    answer can be neither a copy nor in another language. A response that doesn't end in a mark of punctuation is
    truncated if its last word in lower case is found neither in a prompt nor inside a response, and either begins such a
    word or was seen at least least_seen times, always at the end; if it ends in part of a name of the prompt; or if its last
    four tokens end less than least_rate of the responses they occur in: tokens seen less than least_seen times say
    nothing, then the last three, two, one, or the ones before the last count. Rows with a null id are kept with a null
    id. The counts cover all rows; they are summed in the tasks before the shuffle, and of them only those of ends that are
    looked for are joined, salted, since a few endings are shared by many rows.
    """
    src = spread(df.select(df[id_col].alias("id"), df[prompt_col].alias("prompt"), df[answer_col].alias("answer")))

    def count(batches):
        for batch in batches:
            seen: Counter[str] = Counter()
            ends: Counter[str] = Counter()
            words: set[str] = set()
            for p, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p:
                    words.update(LOWER.findall(p))
                if a and has_word(a):
                    c = contexts(a.strip())
                    for keys in c:
                        seen.update(keys)
                    words.update(keys[-1] for keys in c[:-1])
                    if c:
                        ends.update(c[-1])
            words = {w for w in words if w.isalpha() and w.islower()}
            seen.update(KNOWN + w for w in words)
            seen.update({BEGUN + w[:i] for w in words for i in range(1, len(w))})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([ends[c] for c in seen], pa.int64())], names=["c", "seen", "ends"])

    stats = src.select("prompt", "answer").mapInArrow(count, "c string, seen bigint, ends bigint").groupBy("c").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    marked = F.col("c").startswith(KNOWN) | F.col("c").startswith(BEGUN)
    stats = stats.where((F.col("seen") >= least_seen) | marked).select("c", (F.col("ends") / F.col("seen")).alias("rate"))

    def look(batches):
        for batch in batches:
            pairs = [*zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = [first_look(p, a) for p, a in pairs]
            other = [not d and speaks_other(p, a) for (d, _), (p, a) in zip(rows, pairs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.list_(pa.string())), pa.array(other, pa.bool_())], names=["id", "defect", "keys", "other"])

    seen = src.mapInArrow(look, f"id {dict(df.dtypes)[id_col]}, defect string, keys array<string>, other boolean")
    seen = cut_lineage(seen.where("defect <> '' or size(keys) > 0 or other").distinct())
    sure = seen.where("size(keys) = 0").select("id", F.when(F.col("defect") == "", "other_language").otherwise(F.col("defect")).alias("defect"))
    salts = 8
    open_ = seen.where("size(keys) > 0").select("id", "keys", "other", F.posexplode("keys").alias("at", "c")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    wanted = stats.join(open_.select("c").distinct(), "c", "left_semi")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    is_known, is_begun = F.col("c").startswith(KNOWN), F.col("c").startswith(BEGUN)
    have = F.col("rate").isNotNull()
    last = F.col("c") == F.substring_index(F.element_at("keys", 1), ":", -1)
    open_ = open_.join(salted, ["c", "salt"], "left").groupBy("id", "keys", "other").agg(
        F.min_by("rate", F.when(have & ~is_known & ~is_begun, F.col("at"))).alias("rate"),
        F.bool_or(is_known & ~have).alias("unknown"),
        F.bool_or((is_begun & have) | (last & have & (F.col("rate") == 1))).alias("broken"),
    )
    cut_short = (F.coalesce("rate", F.lit(1.0)) < least_rate) | (F.col("unknown") & F.col("broken"))
    judged = open_.select("id", F.when(cut_short, "truncated").when(F.col("other"), "other_language").alias("defect")).where("defect is not null")
    return sure.unionByName(judged).distinct().select(F.col("id").alias(id_col), "defect")
