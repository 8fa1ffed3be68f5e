import random
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regionkit.llm import bpe, mix, split

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(bpe.default_path()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library_does(vocabulary, library, text):
    assert vocabulary.encode([text])[0] == library(text)


def test_blanks_contractions_and_long_words(vocabulary, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeñ é's1２ \n\t.,日\x1c\x85") for _ in range(200)) for _ in range(200)] + ["a" * 5000, "<|endoftext|>", " " * 300 + "x", "don't we'll I'D"]
    assert [vocabulary.encode([t])[0] for t in texts] == [library(t) for t in texts]


def test_every_token_is_itself(vocabulary):
    words = [t.decode() for t in vocabulary.rank if t.isascii() and t.isalpha()]
    vocabulary.encode_words(words)
    assert all(vocabulary.words[w] == (vocabulary.rank[w.encode()],) for w in words)


def test_corpus_rows(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "ab " * 20_000, "x"), (None, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((r[0] or 0, library(r[1] or "")) for r in rows)
    assert bpe.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def check(v, text, pieces, limit, overlap):
    end = 0
    for k, (a, b, n) in enumerate(pieces):
        assert a < b and a <= end < b if k else a == 0
        assert v.count([text[a:b]])[0] == n <= limit
        assert v.count([text[a:end]])[0] <= overlap if k else True
        end = b
    assert end == len(text)


@pytest.mark.parametrize("limit,overlap", [(20, 5), (7, 2), (50, 20), (3, 0)])
def test_pieces_cover_fit_and_overlap(vocabulary, limit, overlap):
    rng = random.Random(limit)
    for _ in range(150):
        t = "".join(rng.choice(["abc", "Zq", "日本", "。", "\n\n", " ", "  ", ". ", "!", "🙂", "x" * rng.randint(1, 60), "7 "]) for _ in range(rng.randint(1, 80)))
        check(vocabulary, t, split.pieces_of(vocabulary, t, limit, overlap), limit, overlap)


@pytest.mark.parametrize("alphabet,n", [(string.ascii_letters + string.digits + "+/", 4_000_000), (string.ascii_lowercase, 300_000), ("日本語中文字漢的一是不了人我在有他", 100_000), ("a", 300_000), ("é'!", 100_000)])
def test_unbroken_runs_take_little_more_than_their_encoding(alphabet, n):
    t = "".join(random.Random(n).choices(alphabet, k=n))
    fresh = lambda: bpe.Vocabulary(bpe.read_vocabulary(bpe.default_path()))
    v = fresh()
    began = time.process_time()
    v.encode([t])
    plain = time.process_time() - began
    v = fresh()
    began = time.process_time()
    pieces = split.pieces_of(v, t, 2000, 100)
    assert time.process_time() - began < 3 * plain + 1
    assert v.held <= 2 * bpe.MAX_HELD
    check(v, t, pieces, 2000, 100)
    assert min(n for _, _, n in pieces[:-1]) > 1000 and len(pieces) > 1


def test_prefixes_of_words_as_encoded_alone(vocabulary):
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("abcé日🙂") for _ in range(rng.randint(1, 40)))
        most = rng.randint(0, 12)
        end, sizes = vocabulary.prefix(t, 0, len(t), most)
        counts = [len(vocabulary.encode([t[:k]])[0]) for k in range(len(t) + 1)]
        assert end == max(k for k, n in enumerate(counts) if n <= most) and len(sizes) == counts[end]
        assert sum(sizes) == len(t[:end].encode())


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_HELD", 50_000)
    v = bpe.Vocabulary(bpe.read_vocabulary(bpe.default_path()))
    rng = random.Random(3)
    for _ in range(60):
        v.encode(["".join(rng.choices(string.ascii_lowercase + " ", k=3000)), "".join(rng.choices(string.ascii_lowercase, k=3000))])
        assert v.held < 50_000 + 3000 * 250 and not any(len(c) > bpe.LONG for c in {*v.words, *v.chunks} - {*v.passing})


def test_cut_at_paragraphs_first(vocabulary):
    text = "One two three four. Five six seven.\n\nEight nine ten eleven twelve. Thirteen."
    a, b, _ = split.pieces_of(vocabulary, text, 14, 0)[0]
    assert text[a:b] == "One two three four. Five six seven."


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "word " * 900, 1), (2, None, 1), (3, "", 1), (4, "short", 1), (4, "short", 1), (5, "é" * 3000, 1)], "doc_id bigint, text string, piece int")
    got = split.split_oversized(df, "doc_id", "text", 100, 10).collect()
    assert {r.doc_id for r in got if r.n_pieces > 1} == {1, 5}
    assert sorted((r.doc_id, r.n_tokens, r.piece_text) for r in got if r.n_pieces == 1) == [(2, 0, ""), (3, 0, ""), (4, 1, "short"), (4, 1, "short")]
    only = split.split_oversized(df, "doc_id", "text", 100, 10, only_oversized=True)
    assert only.exceptAll(spark.createDataFrame(got, only.schema)).count() == 0 and {r.doc_id for r in only.collect()} == {1, 5}
    assert split.split_oversized(df.where("false"), "doc_id", "text").count() == 0
    bare = split.split_oversized(df, "doc_id", "text", 100, 10, texts=False)
    assert "piece_text" not in bare.columns and bare.count() == len(got)
    torn = spark.createDataFrame([(1, bytearray(b"\xff1" * 60))], "doc_id bigint, text binary")  # no UTF-8
    assert split.split_oversized(torn, "doc_id", "text", 100, 10, only_oversized=True).count() == split.split_oversized(torn, "doc_id", "text", 100, 10).count() == 2
    with pytest.raises(ValueError):
        split.split_oversized(df, "doc_id", "text", 10, 5)


def test_mix_reaches_weights_within_caps(spark):
    rng = random.Random(0)
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, "w " * rng.randint(1, 30)) for i in range(900)] + [(1000, "unlisted", "a b"), (1001, "big", None), (1002, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    sized = mix.sized_documents(docs, "doc_id", "source", "text")
    m, shares = mix.mix_sources(sized, targets)
    got, s = m.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big", "small"}
    assert max(r.times for r in got if r.source == "big") == 1 and max(r.times for r in got if r.source == "small") <= 3
    assert s["none"].actual_share == 0.0 and set(s) == {"big", "small", "none"}
    assert s["big"].actual_share == pytest.approx(2 / 3, abs=0.01) and s["small"].actual_share == pytest.approx(1 / 3, abs=0.01)
    for r in s.values():
        assert r.tokens_used == sum(x.n_tokens * x.times for x in got if x.source == r.source) <= r.tokens_budget
    # whole epochs first: within a source, numbers of uses differ by at most one
    for k in ("big", "small"):
        t = {x.times for x in got if x.source == k}
        assert max(t) - min(t) <= 1
    # brute force of the fractional part: by key, as long as the prefix sum fits
    rows = sorted((r for r in sized.collect() if r.source == "small"), key=lambda r: (-r.u, r.doc))
    held = sum(r.n_tokens for r in rows)
    epochs, rest, total, want = s["small"].tokens_budget // held, s["small"].tokens_budget % held, 0, {}
    for r in rows:
        total += r.n_tokens
        if n := epochs + (total <= rest):
            want[r.doc] = n
    assert {r.doc_id: r.times for r in got if r.source == "small"} == want
    assert mix.mix_sources(sized.where("false"), targets)[0].count() == 0
