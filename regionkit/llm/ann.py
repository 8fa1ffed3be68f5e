"""The k most similar vectors of every vector, by multi-index hashing of learned binary codes.

Rotations learned on a bounded sample give each vector several binary codes (tables). A code is split into m substrings,
by each of which all vectors are indexed. Two codes within the Hamming radius 2m - 1 agree in at least one substring
up to one bit (pigeonhole), so each substring is looked up as it is and with each of its bits flipped; of a pair that
differs in a bit, only the side with the 0 flips it. That finds every code within the radius, and only those are kept.
The number of tables is such that pairs at the least similarity wanted lie within the radius of one of them. Pairs that
met are ranked by their floats.

A row isn't sent to each bucket that it looks up, but, packed with others, to the few groups of buckets in which these
lie; the rest of the bits is flipped there. Tables are taken a few at a time, so that what lies on disk at once doesn't
grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_and_free, parallelism
from .topn import top_n_per_group

SAMPLE = 8192
COSINE, EUCLID = "cosine", "euclid"
#: Bits of the word that travels with a lookup beside its code, to tell most chance meetings from others.
WORD = 62
#: Rows of a group of buckets, which a task holds at once (unless they crowd); bytes of a task's share of a round, and of a round at least.
GROUP, SHARE, ROUND = 1 << 17, 16 << 20, 256 << 20
#: What a meeting and a pair of floats to be compared cost, if a lookup, which is shuffled, costs 1.
MEETING, COMPARISON = 0.02, 3.0


def learned_rotations(x: np.ndarray, count: int, seed: int = 5, rounds: int = 15) -> np.ndarray:
    """count rotations (d x d), each turned step by step so that the signs of the rotated sample lie close to it."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, axis=1)


class Codes:
    """Everything that turns vectors into codes: mean, rotations, thresholds, number and length of tables and substrings.

    Two or three substrings of a length at which a row costs least: its lookups, and its expected chance meetings. For
    each there are as many tables as it takes for a vector and another at the similarity `near` to lie within the radius
    of one with probability `recall`, measured on the sample; as many rotations are learned as that needs. Substrings of
    one bit meet always, so some length reaches any recall; over `widest` bits in all, a cheaper one is not looked for.
    """

    def __init__(self, sample: np.ndarray, n: int, metric: str, near: float, recall: float = 0.985, longest: int = 29, widest: int = 8192):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True) if metric == COSINE else sample
        self.metric = metric
        self.mean = x.mean(axis=0)
        x = x - self.mean
        if few := len(x) < 1000:
            x = np.tile(x, (-(-1000 // len(x)), 1))  # each row is moved in several directions
        step = np.random.default_rng(3).standard_normal(x.shape)
        if metric == COSINE:
            base = x + self.mean
            step -= (step * base).sum(1, keepdims=True) * base
            step /= np.linalg.norm(step, axis=1, keepdims=True)
            moved = near * base + math.sqrt(1 - near * near) * step - self.mean
        else:
            moved = x + near * step / np.linalg.norm(step, axis=1, keepdims=True)
        # random pairs that aren't wanted, by which the chance of a meeting is measured
        a = (x[:1200] + self.mean) if metric == COSINE else x[:1200]
        apart = a @ a.T < near if metric == COSINE else (a * a).sum(1)[:, None] + (a * a).sum(1)[None] - 2 * a @ a.T > near * near
        width = 768
        while True:
            turn, cut, on, flips = self._bits(x, moved, width, metric, few)
            # the last bits are for the check
            self.turn, self.cut, self.slack = turn[:, -WORD:], cut[-WORD:], int(math.ceil(np.quantile(flips[:, -WORD:].sum(1), 0.999)))
            if metric == EUCLID:
                self.lines = np.linalg.qr(np.random.default_rng(2).standard_normal((x.shape[1], x.shape[1])))[0][:, :8]
                along = x @ self.lines
                self.start, self.step, self.near = along.min(0), np.maximum((along.max(0) - along.min(0)) / 255, 1e-12), near
            c = self.check(a - self.mean if metric == COSINE else a)
            i, j = np.divmod(np.arange(len(c) ** 2), len(c))
            passes = self.passes(c[i], c[j]).reshape(len(c), -1) & apart
            sure, hoped = self._costs(on[:, :-WORD], flips[:, :-WORD], apart, passes, n, recall, longest)
            if hoped >= sure or width >= widest:
                break
            width = min(widest, math.ceil(1.2 * hoped[3] * hoped[1] * hoped[2]) + WORD)
        _, self.m, self.bits, self.tables = sure
        self.length, self.radius = self.m * self.bits, 2 * self.m - 1
        self.turn, self.cut = np.concatenate([turn[:, : self.tables * self.length], self.turn], axis=1), np.concatenate([cut[: self.tables * self.length], self.cut])

    def check(self, x: np.ndarray) -> np.ndarray:
        """A word for each row of centered vectors: signs, or for places up to eight coordinates in steps of 1/255 of their range."""
        if self.metric == COSINE:
            return (x @ self.turn[:, -WORD:] > self.cut[-WORD:]) @ (1 << np.arange(WORD, dtype=np.int64))
        at = np.zeros((len(x), 8), np.uint8)
        at[:, : self.lines.shape[1]] = np.clip(np.floor((x @ self.lines - self.start) / self.step), 0, 255)
        return at.view(np.int64)[:, 0]

    def passes(self, c: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whether pairs of check words are as near as a wanted pair's are: of signs, with one of a thousand left out; of places, all."""
        if self.metric == COSINE:
            return np.bitwise_count(c ^ e) <= self.slack
        step = np.zeros(8)
        step[: len(self.step)] = self.step
        apart = np.abs(c.view(np.uint8).reshape(-1, 8).astype(np.int16) - e.view(np.uint8).reshape(-1, 8))
        return ((np.maximum(apart - 1, 0) * step) ** 2).sum(1) <= self.near * self.near * (1 + 1e-9)

    @staticmethod
    def _bits(x: np.ndarray, moved: np.ndarray, width: int, metric: str, few: bool):
        """Columns of rotations, their cuts, the bits of x, and which of them flip between x and moved."""
        # of the sample, one half teaches the rotations, and the other, which they don't fit better than any vector, measures
        turn = learned_rotations(x if few else x[::2], -(-width // x.shape[1]))[:, :width]
        turn = turn[:, np.random.default_rng(9).permutation(turn.shape[1])]
        y, z = x @ turn, moved @ turn
        # the middle for directions; for places, cuts spread over the range, as cuts through the middle alone leave cones.
        # A cut moves aside if it would go through a crowd, whose members would fall on either side of it by chance.
        share = np.full(width, 0.5) if metric == COSINE else np.random.default_rng(11).uniform(0.1, 0.9, width)
        cut = np.array([np.quantile(c, q) for c, q in zip(y.T, share)])
        split = ((y > cut) != (z > cut)).mean(axis=0)
        for i in np.flatnonzero((split > 2 * np.median(split)) | few):
            at = np.linspace(0.1, 0.9, 17)
            c = np.quantile(y[:, i], at)
            cut[i] = c[np.argmin(((y[:, i, None] > c) != (z[:, i, None] > c)).mean(axis=0) + 0.05 * np.abs(at - share[i]))]
        on = y > cut
        return turn, cut, on, ((z > cut) != on)[slice(None) if few else slice(1, None, 2)]

    @staticmethod
    def _costs(on: np.ndarray, flips: np.ndarray, apart: np.ndarray, passes: np.ndarray, n: int, recall: float, longest: int) -> tuple[tuple, tuple]:
        """(cost, m, bits, tables) of the cheapest index that reaches recall with these bits, and of the one that more might give."""
        some = (on[: len(apart)] * 2 - 1).astype(np.float32)

        def share(start: int, bits: int, most: int, of: np.ndarray) -> float:
            """Of random pairs that aren't wanted, how many are among `of` and differ in at most so many of these bits."""
            return ((some[:, start : start + bits] @ some[:, start : start + bits].T >= bits - 2 * most) & of).sum() / max(1, apart.sum())

        sure, hoped = [], []
        for bits in range(1, longest + 1):
            chance = (share(0, bits, 1, apart) + share(bits, bits, 1, apart)) / 2
            for m in (2, 3):
                length = m * bits
                if length > WORD:
                    continue
                passed = (share(0, length, 2 * m - 1, passes) + share(length, length, 2 * m - 1, passes)) / 2
                per = m * (1 + bits / 2 + MEETING * chance * n / 2) + COMPARISON * passed * n / 2
                most = flips.shape[1] // length
                inside = flips[:, : most * length].reshape(len(flips), most, length).sum(2) <= 2 * m - 1
                met = np.logical_or.accumulate(inside, axis=1).mean(axis=0)
                if met[-1] >= recall:
                    tables = int(np.argmax(met >= recall)) + 1
                    sure.append((tables * per, m, bits, tables))
                else:
                    # of pairs that have no more to do with each other in one table than in the next, each finds the same share
                    miss = (1 - met[-1]) ** (1 / most)
                    tables = math.ceil(math.log(1 - recall) / math.log(miss)) if 0 < miss < 1 else 1 << 30
                    hoped.append((tables * per, m, bits, tables))
        return min(sure), min(hoped, default=(math.inf,))

    def __call__(self, x: np.ndarray, tables: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Substrings (n x tables * m), codes (n x tables) and check words of vectors, in these tables (default: all)."""
        tables = range(self.tables) if tables is None else tables
        if self.metric == COSINE:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x - self.mean
        of = slice(tables.start * self.length, tables.stop * self.length)
        on = x @ self.turn[:, of] > self.cut[of]
        subs = on.reshape(len(x), len(tables) * self.m, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))
        return subs, on.reshape(len(x), len(tables), self.length) @ (1 << np.arange(self.length, dtype=np.int64)), self.check(x)

    def meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the rows of x and y are candidates of each other."""
        (_, a, c), (_, b, e) = self(x), self(y)
        return (np.bitwise_count(a ^ b) <= self.radius).any(axis=1) & self.passes(c, e)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, nonzero: bool) -> DataFrame:
    """id, v (of floats if they are, else of doubles) of the rows that count: v of dim finite components, not all zero if nonzero."""
    v = df[vec_col] if dict(df.dtypes)[vec_col] == "array<float>" else df[vec_col].cast("array<double>")
    src = df.select(df[id_col].alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    src = src.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return src.where((F.array_min("v") < 0) | (F.array_max("v") > 0)) if nonzero else src


def similarity(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of the rows of x and y; larger is nearer: the cosine, or the distance times -1."""
    if metric == COSINE:
        return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return -np.sqrt(((x - y) ** 2).sum(1))


def scored_pairs(met: DataFrame, classes: DataFrame, metric: str, least: float) -> DataFrame:
    """(a, b, sim) of the pairs whose vectors are at least so similar."""
    a, b = (classes.select(F.col("cls").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) for i in (2, 3))
                sim = similarity(x, y, metric)
                at = pa.array(np.flatnonzero(sim >= least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sim).take(at)], names=["a", "b", "sim"])

    return met.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint, sim double")


def _block(metric: str, k: int, least: float):
    """Best k partners on either side between two blocks of one crowded bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        x, y = np.stack(left.v.to_numpy()).astype(float), np.stack(right.v.to_numpy()).astype(float)
        if metric == COSINE:
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            s = x @ y.T
        else:
            s = -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
        p, q = left.cls.to_numpy(), right.cls.to_numpy()
        s[p[:, None] == q[None]] = -np.inf
        pairs = []
        for m, n, o in ((s, p, q), (s.T, q, p)):
            top = min(k, m.shape[1])
            at = np.argpartition(-m, top - 1, axis=1)[:, :top]
            ok = np.take_along_axis(m, at, 1) >= least - 1e-6
            pairs.append(np.stack([np.repeat(n, ok.sum(1)), o[at[ok]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def _placed(own: np.ndarray, bits: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): each row in its bucket own, with the key of the bucket number times two; and once more, with the bucket
    number times two plus one, in those that one more of these bits leads to."""
    clear = [(b, np.flatnonzero(own & (1 << b) == 0)) for b in bits]
    return np.concatenate([np.arange(len(own)), *(c for _, c in clear)]), np.concatenate([own << 1, *((own[c] | 1 << b) << 1 | 1 for b, c in clear)])


def _entries(codes: Codes, cls: np.ndarray, v: np.ndarray, tables: range | None = None, low: int = 0):
    """Key, class number, code and check word of each row in its buckets and in those that one more bit of the substring
    from the bit `low` on leads to, substring by substring of these tables (default: all)."""
    subs, words, check = codes(v, tables)
    first = tables.start * codes.m if tables else 0
    for i in range(subs.shape[1]):
        at, key = _placed(subs[:, i], range(low, codes.bits))
        yield key | first + i << 33, cls[at], words[at, i // codes.m], check[at]


def _packed(codes: Codes, low: int, key: np.ndarray, cls: np.ndarray, word: np.ndarray, check: np.ndarray):
    """(group, bytes): the entries by groups of buckets that differ in the low bits only, without their keys, which the codes tell."""
    group = key >> (low + 1)
    order = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1
    size = -(-codes.length // 8)
    for start, end in zip([0, *ends[:-1]], ends):
        at = order[start:end]
        yield int(group[at[0]]), cls[at].tobytes() + check[at].tobytes() + word[at].view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(codes: Codes, low: int, group: int, blobs: list[bytes]) -> list[np.ndarray]:
    """Entries of a group as of _entries, with those that the low bits lead to, in the order of key."""
    size = -(-codes.length // 8)
    parts: list[list[np.ndarray]] = [[], [], []]
    for blob in blobs:
        n = len(blob) // (16 + size)
        word = np.zeros((n, 8), np.uint8)
        word[:, :size] = np.frombuffer(blob, np.uint8, offset=16 * n).reshape(n, size)
        for part, x in zip(parts, (np.frombuffer(blob, np.int64, n), word.view(np.int64)[:, 0], np.frombuffer(blob, np.int64, n, 8 * n))):
            part.append(x)
    cls, word, check = (np.concatenate(x) for x in parts)
    sub, prefix = group >> (32 - low), group << low & (1 << codes.bits) - 1
    own = word >> (sub % codes.m * codes.bits) & ((1 << codes.bits) - 1)
    here = np.flatnonzero(own >> low == prefix >> low)
    there = np.flatnonzero(own >> low != prefix >> low)
    at, key = _placed(own[here], range(low))
    at, key = np.concatenate([here[at], there]), np.concatenate([key, (own[there] & ((1 << low) - 1) | prefix) << 1 | 1])
    order = np.argsort(key)
    at = at[order]
    return [key[order] | sub << 33, cls[at], word[at], check[at]]


def _pairs_met(codes: Codes, key: np.ndarray, cls: np.ndarray, word: np.ndarray, check: np.ndarray, most: int = 1_000_000):
    """Pairs of classes within the radius, of entries in the order of key: a row placed in a bucket with all that come later in it."""
    bucket = key >> 1
    end = np.searchsorted(bucket, bucket, side="right")
    placed = np.flatnonzero(key & 1 == 0)
    n = end[placed] - 1 - placed
    placed, n = placed[n > 0], n[n > 0]
    total = np.cumsum(n)
    start = 0
    while start < len(placed):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most)))
        i, m = placed[start:stop], n[start:stop]
        first = np.cumsum(m) - m
        left = np.repeat(i, m)
        right = left + 1 + np.arange(len(left)) - np.repeat(first, m)
        x = word[left] ^ word[right]
        near = np.flatnonzero(np.bitwise_count(x) <= codes.radius)
        x, left, right = x[near], left[near], right[near]
        # of the substrings by which two codes of a table meet, the first counts
        ok, j = codes.passes(check[left], check[right]), (key[left] >> 33) % codes.m
        for k in range(codes.m - 1):
            ok &= (j <= k) | (np.bitwise_count(x >> (k * codes.bits) & ((1 << codes.bits) - 1)) > 1)
        a, b = cls[left[ok]], cls[right[ok]]
        yield np.minimum(a, b), np.maximum(a, b)
        start = stop


def _grouped(batches):
    """(number, list of its bytes) of sorted rows of a number and bytes, over the borders of batches."""
    last, blobs = None, []
    for batch in batches:
        for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if g != last and blobs:
                yield last, blobs
                blobs = []
            last = g
            blobs.append(x)
    if blobs:
        yield last, blobs


def candidate_pairs(classes: DataFrame, codes: Codes, metric: str, k: int, least: float, crowded: int = 4_000_000, block: int = 1024) -> DataFrame:
    """Distinct (a, b), a < b, of class numbers whose codes lie within the radius in a table, and whose check words pass.

    A substring's buckets are grouped by their upper bits. A row is sent, packed with others, to its own group and to those
    that one of the upper bits leads to; there it looks up by the lower bits. Groups are compared one by one; pairs that met
    are written, packed by a hash, and freed of repetitions at the end. Tables are taken a few at a time: what a round
    shuffles weighs about twice what the vectors do, and is deleted before the next one begins.
    A bucket with more than `crowded` pairs isn't compared there: its rows are split into blocks of about `block`, every
    block meets every other, and each row keeps its k nearest of each block, which loses none of the k nearest.
    """
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    upper = min(codes.bits, max(4, math.ceil(math.log2(max(1, n / GROUP)))))
    low = codes.bits - upper
    of_table = n * codes.m * (1 + upper / 2) * (16 + -(-codes.length // 8))
    together = max(1, int(max(ROUND, 8 * n * width) / of_table))
    parts = max(16, n // 50_000)

    def coded(tables: range):
        def run(batches):
            held, rows = [], 0

            def close():
                cls, v = (np.concatenate(x) for x in zip(*held))
                for entries in _entries(codes, cls, v, tables, low):
                    packed = [*_packed(codes, low, *entries)]
                    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in packed], pa.int64()), pa.array([x for _, x in packed], pa.binary())], names=["g", "packed"])

            for batch in batches:
                if m := batch.num_rows:
                    held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1).astype(float)))
                    rows += m
                if rows >= 20_000:
                    yield from close()
                    held, rows = [], 0
            if rows:
                yield from close()

        return classes.select("cls", "v").mapInArrow(run, "g bigint, packed binary")

    def meet(batches):
        def close(group: int, blobs: list[bytes]):
            entries = _unpacked(codes, low, group, blobs)
            bucket = entries[0] >> 1
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            reach = np.diff(starts, append=len(bucket))
            own = np.add.reduceat(1 - (entries[0] & 1), starts)
            if (crowd := own * reach > crowded).any():
                of = np.repeat(np.arange(len(starts)), reach)
                at = np.flatnonzero(crowd[of])
                of, key = of[at], entries[0][at]
                yield out(bucket=pa.array(key >> 1), cls=pa.array(entries[1][at]), far=pa.array(key & 1), bn=pa.array(-(-own[of] // block)), bp=pa.array(-(-reach[of] // block)))
                entries = [x[np.repeat(~crowd, reach)] for x in entries]
            for a, b in _pairs_met(codes, *entries, most=1 << 17):
                if len(a):
                    held.append((a, b))
                    if sum(len(x) for x, _ in held) > 1 << 20:
                        yield flush()

        def out(**cols):
            size = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(size, kind) for c, kind in kinds.items()], names=[*kinds])

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = (a ^ b) % parts
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
            ats = [order[start:end] for start, end in zip([0, *ends[:-1]], ends)]
            return out(part=pa.array([part[at[0]] for at in ats], pa.int64()), pairs=pa.array([np.stack([a[at], b[at]], 1).tobytes() for at in ats], pa.binary()))

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for group, blobs in _grouped(batches):
            yield from close(group, blobs)
        if held:
            yield flush()

    def distinct(batches):
        for _, blobs in _grouped(batches):
            x = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    kinds = {"part": pa.int64(), "pairs": pa.binary(), "bucket": pa.int64(), "cls": pa.int64(), "far": pa.int64(), "bn": pa.int64(), "bp": pa.int64()}
    schema = "part bigint, pairs binary, bucket bigint, cls bigint, far bigint, bn bigint, bp bigint"
    rounds = []
    for start in range(0, codes.tables, together):
        tables = range(start, min(codes.tables, start + together))
        tasks = max(parallelism(classes.sparkSession), int(of_table * len(tables) / SHARE))
        rounds.append(cut_and_free(coded(tables).repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(meet, schema)))
    met = reduce(DataFrame.unionByName, rounds)
    tasks = max(parallelism(classes.sparkSession), (met.where("part is not null").agg(F.sum(F.length("pairs"))).first()[0] or 0) // SHARE)
    pairs = met.where("part is not null").select("part", "pairs").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(distinct, "a bigint, b bigint")
    hot = met.where("bucket is not null").select("bucket", "cls", "far", "bn", "bp")
    if not hot.limit(1).count():
        return pairs
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = hot.where("far = 0").select("bucket", "cls", F.lit(0).alias("side"), F.pmod(F.xxhash64("cls"), F.col("bn")).alias("i"), upto("bp").alias("j"))
    two = hot.select("bucket", "cls", F.lit(1).alias("side"), upto("bn").alias("i"), F.pmod(F.xxhash64("cls"), F.col("bp")).alias("j"))
    both = one.unionByName(two).join(classes.select("cls", "v"), "cls")
    return pairs.unionByName(both.groupBy("bucket", "i", "j").applyInPandas(_block(metric, k, least), "a bigint, b bigint")).distinct()


def classes_of(src: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(members, classes, number of classes): members has cls and id once for each id, classes cls and v.

    Vectors are grouped by themselves; their class number is a hash, drawn anew if two vectors should share one. Vectors
    move twice, the second time to the place of their number, where they are joined later; ids are matched by class number. Of different vectors under one id the smallest counts.
    """
    vectors = src.select("v").distinct()
    tasks = parallelism(src.sparkSession, src, SHARE)
    for seed in count(5):
        cls = F.xxhash64(F.lit(seed), F.col("v")).alias("cls")
        classes = cut_and_free(vectors.select(cls, "v").repartition(tasks, "cls"), placed=True)
        n, kinds = classes.agg(F.count("*"), F.countDistinct("cls")).first()
        if n == kinds:
            break
    members = cut_and_free(src.select(cls, "id").distinct())
    several = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if several.limit(1).count():
        smallest = members.join(several, "id").join(classes, "cls").groupBy("id").agg(F.min_by("cls", "v").alias("cls"))
        members = cut_and_free(members.join(several, "id", "left_anti").unionByName(smallest))
        classes = cut_and_free(classes.join(members.select("cls").distinct(), "cls", "left_semi").repartition(tasks, "cls"), placed=True)
        n = classes.count()
    return members, classes, n


def most_similar(df: DataFrame, id_col: str, vec_col: str, dim: int, metric: str, least: float, k: int = 5, design: float | None = None) -> DataFrame:
    """(id, other, sim): for each vector its k most similar others with a similarity of at least `least`.

    metric is "cosine", or "euclid" with the negative distance as similarity. Ids that are null, and vectors that are
    null, of another length, not finite, or (for cosine) all zero don't count. An id counts once; of different vectors
    under one id the smallest counts. Equal similarities are ordered by the smaller id. Equal vectors form a class,
    searched once; at least two classes are needed for a search. `design` is the similarity for which the number of
    tables is chosen (default: `least`), measured on the half of at most 8,192 sampled classes that the rotations
    aren't learned from; all rows are indexed and all are queries.
    """
    members, classes, n = classes_of(valid_vectors(df, id_col, vec_col, dim, metric == COSINE))
    kinds = f"`{id_col}` {dict(df.dtypes)[id_col]}, other {dict(df.dtypes)[id_col]}, sim double"
    if n == 0:
        return df.sparkSession.createDataFrame([], kinds)
    six = top_n_per_group(members.withColumn("z", F.lit(0.0)), "cls", "id", "z", k + 1).select("cls", F.col("id").alias("other"))
    size = members.groupBy("cls").agg(F.count("*").alias("n"))
    salts = 16
    salted = six.join(size.where("n > 1"), "cls").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    inner = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["cls", "salt"]).where("id <> other")
    inner = inner.select("id", "other", F.lit(1.0 if metric == COSINE else 0.0).alias("sim"))
    if n == 1:
        near = inner
    else:
        part = F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < min(1_000_000, int(2e6 * SAMPLE / n) + 1)  # about twice the sample
        sample = classes.where(part).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").toPandas().v
        codes = Codes(np.stack(sample.to_numpy()).astype(float), n, metric, (design if design is not None else least) * (1 if metric == COSINE else -1))
        met = candidate_pairs(classes, codes, metric, k, least)
        scored = cut_and_free(scored_pairs(met, classes, metric, least))
        way = scored.select(F.col("a").alias("cls"), F.col("b").alias("to"), "sim").unionByName(scored.select(F.col("b").alias("cls"), F.col("a").alias("to"), "sim"))
        way = way.join(size.where(F.col("n") > k).select("cls"), "cls", "left_anti")  # larger classes are their own nearest
        top = Window.partitionBy("cls").orderBy(F.col("sim").desc(), "other")
        outer = way.join(six.withColumnRenamed("cls", "to"), "to").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("cls", "other", "sim")
        near = inner.unionByName(outer.join(members, "cls").select("id", "other", "sim"))
    best = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return near.select(F.col("id").alias(id_col), "other", "sim")
