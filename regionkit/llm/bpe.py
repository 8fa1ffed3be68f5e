"""Byte-level BPE on distinct words, by last-token states carried along a word trie.

The BPE encoding of a word prefix ends in exactly one token t such that the rest is the encoding of the
shorter prefix and t may follow that one's last token. A node of the trie of distinct words therefore needs
only its last token; the depth-first walk computes it once for all words that share the prefix. Visiting the
words in sorted order with a stack of states is that walk.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The vocabulary's published pre-token pattern, and Unicode's White_Space characters.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t-\r \x85\xa0  -     　"

#: A run of white space with the run of other characters behind it: no pre-token reaches over its end.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Bytes that a worker keeps of words and chunks it has seen, about; and the length from which one is not kept.
MAX_HELD, LONG = 64_000_000, 512


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks, last merges and a trie of reversed tokens."""

    def __init__(self, data: bytes):
        self.rank = rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        size = max(rank.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.merge: dict[int, int] = {}
        self.known: dict[int, bool] = {}
        for token, t in sorted(rank.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                a, b = rank.get(token[:i], size), rank.get(token[i:], size)
                if a < t and b < t and self.follows(a, b, keep=False):
                    self.merge[a << 20 | b] = t
                    self.left[t], self.right[t] = a, b
                    break
        self.back: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, t in rank.items():
            node = 0
            for byte in reversed(token):
                node = self.back.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = t
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.passing: list[str] = []  # long words and chunks, which go with the next texts
        self.longest_token = max(map(len, rank), default=1)
        self.split = regex.compile(PATTERN).findall

    def follows(self, a: int, b: int, keep: bool = True) -> bool:
        """Whether BPE leaves a and b side by side: no merge over the border comes before those that made them."""
        key = a << 20 | b
        if keep and key in self.known:
            return self.known[key]
        merge, left, right, bound, ok = self.merge, self.left, self.right, 1 << 30, True
        x, y = a, b
        while True:
            if merge.get(x << 20 | y, bound) < bound:
                ok = False
                break
            made_x, made_y = right[x] != x, left[y] != y
            if not made_x and not made_y:
                break
            if made_x and (x > y or not made_y):
                bound, x = x, right[x]
            else:
                bound, y = y + 1, left[y]
        if keep and len(self.known) < 2_000_000:
            self.known[key] = ok
        return ok

    def extend(self, b: bytes, stop: int, last: list[int], size: list[int]) -> None:
        """Carry the last token of each prefix of b, and its bytes, on to the prefix of stop bytes."""
        back, ends, follows = self.back, self.ends, self.follows
        for end in range(len(last), stop + 1):
            node, found = 0, []
            for at in range(end - 1, -1, -1):
                node = back.get(node << 8 | b[at], 0)
                if not node:
                    break
                if (t := ends[node]) >= 0:
                    found.append((at, t))
            for at, t in reversed(found):
                if not at or follows(last[at], t):
                    last.append(t)
                    size.append(end - at)
                    break

    def prefix(self, text: str, start: int, stop: int, most: int) -> tuple[int, list[int]]:
        """The longest prefix of the pre-token text[start:stop] with at most `most` tokens, but for longer ones behind a stretch
        that has over 64 more: where it ends, and the bytes of its tokens. One pass, which ends at that stretch.
        """
        b = text[start : min(stop, start + (most + 65) * self.longest_token)].encode("utf-8", "replace")
        last, size, count, best, n = [-1], [0], [0], 0, len(b)
        while len(count) <= n and count[-1] <= most + 64:
            self.extend(b, min(n, len(last) + 255), last, size)
            for end in range(len(count), len(last)):
                count.append(count[end - size[end]] + 1)
                if count[end] <= most and (end == n or b[end] & 0xC0 != 0x80):
                    best = end
        sizes, at = [], best
        while at:
            sizes.append(size[at])
            at -= size[at]
        return start + len(b[:best].decode()), sizes[::-1]

    def encode_words(self, words: list[str]) -> None:
        """Put the encodings of words into self.words by a depth-first walk over their trie."""
        out = self.words
        todo = []
        for w in words:
            b = w.encode("utf-8", "replace")
            if (t := self.rank.get(b)) is not None:
                out[w] = (t,)
            else:
                todo.append((b, w))
        todo.sort()
        last, size = [-1], [0]  # of the trie node at each depth of the current path
        before = b""
        for b, w in todo:
            n, common = len(b), 0
            top = min(n, len(before))
            while common < top and b[common] == before[common]:
                common += 1
            del last[common + 1 :], size[common + 1 :]
            self.extend(b, n, last, size)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[w] = tuple(ids)
            before = b

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, every distinct one encoded."""
        parts = [CHUNK.findall(t) if t else [] for t in texts]
        for c in self.passing:
            self.chunks.pop(c, None)
            self.words.pop(c, None)
        self.passing = []
        if self.held > MAX_HELD:
            self.chunks.clear()
            self.words.clear()
            self.held = 0
        new = {c for p in parts for c in p if c not in self.chunks}
        if new:
            by = {c: self.split(c) for c in new}
            words = self.words
            fresh = [w for w in {*chain.from_iterable(by.values())} if w not in words]
            self.encode_words(fresh)
            for c, p in by.items():
                self.chunks[c] = words[p[0]] if len(p) == 1 else tuple(chain.from_iterable([words[w] for w in p]))
            for kept, texts in ((words, fresh), (self.chunks, by)):
                for c in texts:
                    if len(c) > LONG:
                        self.passing.append(c)
                    else:
                        self.held += 200 + len(c) + 8 * len(kept[c])
        return parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        chunks = self.chunks
        return [[*chain.from_iterable([chunks[c] for c in p])] for p in self.learn(texts)]

    def count(self, texts: list[str]) -> list[int]:
        chunks = self.chunks
        return [sum([len(chunks[c]) for c in p]) for p in self.learn(texts)]


_loaded: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """One per Python worker, kept between its tasks."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def _slices(texts: pa.Array, most: int = 4_000_000):
    """Row ranges of about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _strings(texts: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in texts.to_pylist()]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Ids of each row's text without special tokens: columns id_col and ids_col (array<int>).

    One row out for each row in, repeated ids included. Null and empty texts give an empty list; text that
    spells a special token is ordinary text; bytes that are no UTF-8 count as U+FFFD. No shuffle.
    """
    data = read_vocabulary(vocabulary_path or default_path())

    def run(batches):
        v = vocabulary(data)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                chunks, parts = v.chunks, v.learn(_strings(batch.column(1).slice(a, b - a)))
                rows = [[chunks[c] for c in p] for p in parts]
                sizes = [sum(map(len, r)) for r in rows]
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, ids_col])

    kind = dict(df.dtypes)[id_col]
    src = df.select(df[id_col], df[text_col].cast("binary").alias("__text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")


def count_tokens(df: DataFrame, text_col: str, keep: list[str], vocabulary_path: str | None = None, count_col: str = "n_tokens") -> DataFrame:
    """The columns `keep` and the number of tokens of text_col (0 for null and empty texts). No shuffle."""
    data = read_vocabulary(vocabulary_path or default_path())

    def run(batches):
        v = vocabulary(data)
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                part = batch.slice(a, b - a)
                n = v.count(_strings(part.column(0)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int32())], names=[*keep, count_col])

    kinds = dict(df.dtypes)
    src = df.select(df[text_col].cast("binary").alias("__text"), *[df[k] for k in keep])
    return src.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{count_col}` int")
