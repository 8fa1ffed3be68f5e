"""Pieces of oversized texts, cut at natural boundaries with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, SPACE, Vocabulary, _slices, _strings, default_path, read_vocabulary, vocabulary

SENTENCE_END = re.compile("[.!?。！？…]['\"’”»)\\]]*$")
IS_SPACE = re.compile(f"[{SPACE}]+$")
PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1


def _units(v: Vocabulary, text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts of the pre-tokens of text, their boundary levels, and prefix sums of their tokens.

    A cut between two pre-tokens of which the first isn't white space leaves both sides' tokens as they are, so
    differences of the prefix sums are the exact token numbers of the pieces. Level 0 is no place for a cut.
    """
    starts, levels, sums, at, total, before = [], [], [0], 0, 0, ""
    for chunk in CHUNK.findall(text):
        for k, word in enumerate(v.split(chunk)):
            if not k:
                gap = chunk[: len(chunk) - len(chunk.lstrip())]
                level = PARAGRAPH if gap.count("\n") > 1 else LINE if "\n" in gap else SENTENCE if SENTENCE_END.search(before[-40:]) else WORD
            else:
                level = 0 if IS_SPACE.match(before) else SENTENCE if SENTENCE_END.search(before[-40:]) and before[-1] in "。！？" else 0 if before[-1].isalnum() and word[0].isalnum() else WORD if ord(word[0]) > 0x2E80 or ord(before[-1]) > 0x2E80 else 0
            starts.append(at)
            levels.append(level if at else PARAGRAPH)
            at += len(word)
            total += len(v.words[word]) if word in v.words else len(v.encode([word])[0])
            sums.append(total)
            before = word
    return starts, levels, sums


class _Run:
    """Hard cuts in a run of characters without a natural boundary.

    Counts of whole pre-tokens come from the prefix sums; only the pre-token in which a cut falls is walked through, up
    to the cut, so that the cuts of a run cost about as much as its encoding.
    """

    def __init__(self, v: Vocabulary, text: str, starts: list[int], sums: list[int]):
        self.v, self.text, self.starts, self.sums = v, text, starts, sums
        self.ends = [*starts[1:], len(text)]

    def count(self, start: int, end: int, known: dict[str, int]) -> int:
        words = self.v.split(self.text[start:end])
        self.v.encode_words(new := [w for w in words if w not in known and w not in self.v.words])
        n = sum(known[w] if w in known else len(self.v.words[w]) for w in words)
        for w in new:
            self.v.words.pop(w, None)
        return n

    def end(self, start: int, stop: int, limit: int) -> tuple[int, int, list[int]]:
        """Where the piece from start ends, its tokens, and the bytes of its tokens in the pre-token that it breaks off in."""
        u = bisect_right(self.starts, start) - 1
        end, used, known, sizes = start, 0, {}, []
        if start > self.starts[u]:
            end, sizes = self.v.prefix(self.text, start, self.ends[u], limit)
            known[self.text[start:end]] = used = len(sizes)
            u += 1
        if start == self.starts[min(u, len(self.starts) - 1)] or end == self.ends[u - 1] < stop:
            top = min(bisect_right(self.sums, self.sums[u] + limit - used) - 1, bisect_left(self.starts, stop))
            if top > u:
                end, used, sizes = self.ends[top - 1], used + self.sums[top] - self.sums[u], []
            if end < stop and used < limit // 2:
                cut, found = self.v.prefix(self.text, end, self.ends[top], limit - used)
                if cut > end:
                    known[self.text[end:cut]] = len(found)
                    end, sizes = cut, found
        end = max(end, start + 1)
        while (n := self.count(start, end, known)) > limit and end > start + 1:
            end, sizes = end - 1, []
        return end, n, sizes

    def back(self, start: int, end: int, sizes: list[int], overlap: int) -> int:
        """The start of the longest tail of text[start:end] of at most overlap tokens: the last ones of the broken pre-token
        and, if these are all of it, whole pre-tokens before it."""
        last = sizes[-overlap:] if overlap else []
        tail = self.text[max(start, end - sum(last)) : end].encode("utf-8", "replace")
        at, places = len(tail), [end]
        for x in reversed(last):
            at -= x
            if tail[at] & 0xC0 != 0x80:
                places.append(end - len(tail[at:].decode("utf-8", "replace")))
        u = bisect_left(self.starts, places[-1])
        if len(last) == len(sizes) and (u == len(self.starts) or self.starts[u] == places[-1]):
            places += [self.starts[k] for k in range(u - 1, bisect_left(self.sums, self.sums[u] - overlap + len(last)) - 1, -1)]
        return next((x for x in reversed(places) if x > start and self.count(x, end, {}) <= overlap), end)


def pieces_of(v: Vocabulary, text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) by character of each piece."""
    parts = v.learn([text])[0]
    if sum(len(v.chunks[c]) for c in parts) <= limit:
        return [(0, len(text), sum(len(v.chunks[c]) for c in parts))]
    starts, levels, sums = _units(v, text)
    by_level = {w: [i for i, x in enumerate(levels) if x >= w] for w in (PARAGRAPH, LINE, SENTENCE, WORD)}
    out: list[tuple[int, int, int]] = []
    i, n, done = 0, len(starts), 0  # done: first unit that no piece holds yet
    while done < n:
        top = bisect_right(sums, sums[i] + limit) - 1  # units i..top-1 fit
        if top >= n:
            out.append((starts[i], len(text), sums[n] - sums[i]))
            break
        half, cut = bisect_left(sums, sums[i] + limit // 2), 0
        for w in (PARAGRAPH, LINE, SENTENCE, WORD):
            at = by_level[w]
            k = bisect_right(at, top) - 1
            if k >= 0 and at[k] > max(done, half if w > WORD else done):
                cut = at[k]
                break
        if not cut:
            # no natural boundary: cuts inside a run of characters
            run = _Run(v, text, starts, sums)
            held, begin = starts[done], starts[min(i, done)]
            k = bisect_right(by_level[WORD], done)
            stop = starts[by_level[WORD][k]] if k < len(by_level[WORD]) else len(text)
            while held < stop:
                end, n_tokens, sizes = run.end(begin, stop, limit)
                if end <= held:
                    begin = held
                    end, n_tokens, sizes = run.end(begin, stop, limit)
                out.append((begin, end, n_tokens))
                held, begin = end, run.back(begin, end, sizes, overlap)
            done = i = bisect_left(starts, stop)
            continue
        out.append((starts[i], starts[cut], sums[cut] - sums[i]))
        first = bisect_left(sums, sums[cut] - overlap)
        back = cut
        for w in (SENTENCE, WORD):
            k = bisect_left(by_level[w], first)
            if k < len(by_level[w]) and by_level[w][k] < cut:
                back = by_level[w][k]
                break
        done, i = cut, max(back, i + 1)
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 100, vocabulary_path: str | None = None, only_oversized: bool = False, texts: bool = True) -> DataFrame:
    """Pieces of at most `limit` tokens: id_col, piece (from 0), n_pieces, start_char, end_char, n_tokens, piece_text.

    The last boundary under the limit is found by binary search in the prefix sums of token counts: the last
    paragraph, line or sentence end in the second half of the room, else the last word end, else a hard cut
    between characters. Each piece but the first starts at most `overlap` tokens before the end of the one
    before it. Null and empty texts give one piece of 0 tokens with an empty text; repeated rows give repeated
    pieces. Bytes that are no UTF-8 count as U+FFFD. only_oversized leaves out what fits in one piece; texts of at most
    `limit` bytes as UTF-8 are then not even sent to Python, since a token has at least one byte. Without `texts` there
    is no piece_text. Time and memory grow with the text, also in runs without any boundary. No shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of limit")
    data = read_vocabulary(vocabulary_path or default_path())
    names = [id_col, "piece", "n_pieces", "start_char", "end_char", "n_tokens", "piece_text"][: 7 if texts else 6]

    def run(batches):
        v = vocabulary(data)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                part = _strings(batch.column(1).slice(a, b - a))
                v.learn(part)
                rows, at = [], []
                for k, text in enumerate(part):
                    found = pieces_of(v, text, limit, overlap)
                    if only_oversized and len(found) == 1:
                        continue
                    rows += [(j, len(found), s, e, n, *([text[s:e]] if texts else [])) for j, (s, e, n) in enumerate(found)]
                    at += [a + k] * len(found)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()][: len(names) - 1]
                cols = [*zip(*rows)] or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.asarray(at, dtype=np.int64))), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    kind = dict(df.dtypes)[id_col]
    src = df.select(df[id_col], df[text_col].cast("binary").alias("__text"))
    if only_oversized:
        size = F.octet_length("__text")
        src = src.where(F.when(F.is_valid_utf8(F.col("__text").cast("string")), size).otherwise(3 * size) > limit)
    return src.mapInArrow(run, f"`{id_col}` {kind}, piece int, n_pieces int, start_char int, end_char int, n_tokens int" + ", piece_text string" * texts)
