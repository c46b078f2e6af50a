"""Periodic runs by block convolution.

A run of period q repeats its first q words at least four times. For the scale L with L <= q < 2L it holds two blocks in a row of a grid
of L words whose words stand again q words later. So at each dyadic scale every block is matched against the 2L - 1 words behind
it: the sum of squared differences at all L distances follows from two sums of squares and one correlation, computed exactly by a
number-theoretic transform, and is zero where the block occurs. Distances that two blocks in a row have in common seed a run, which is compared word
by word in both directions as far as it goes.

Two tests spare transforms and lose nothing. A block can occur at a distance below 2L only if each of its words recurs that soon; and
inside a known run of period p <= L a block of L words occurs at multiples of p only, which give the same run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.blocks import release_memory
from barlight.llm.common import Words, joined_words, mixed, slices, text_bytes

SLICE_BYTES = 4_000_000  # of text looked through at a time; a longer text stands alone
CELLS = 1 << 18  # of one transform of many blocks
P, GENERATOR = 2013265921, 31  # 15 * 2**27 + 1 and a primitive root of it: transforms of up to 2**27 words
LEAST_LENGTH, LEAST_TIMES = 6, 4
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


@lru_cache(maxsize=64)
def roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of a 2 * half-th root of unity (or of its inverse) modulo P, as a column."""
    w = pow(GENERATOR, (P - 1) // (2 * half), P)
    w = pow(w, -1, P) if inverse else w
    out = np.ones(half, np.uint64)
    have = 1
    while have < half:  # doubled up: the powers from `have` on are the first ones times w ** have
        out[have : 2 * have] = out[:have] * np.uint64(pow(w, have, P)) % np.uint64(P)
        have *= 2
    return out[:, None]


def _less(x: np.ndarray) -> np.ndarray:
    return np.minimum(x, x - np.uint64(P))  # below P it wraps to a large number


def transformed(a: np.ndarray) -> np.ndarray:
    """Transform down the columns; the result is in bit-reversed order."""
    n, columns = a.shape
    half = n // 2
    while half:
        a = a.reshape(-1, 2, half, columns)
        u, v = a[:, 0], a[:, 1]
        a = np.stack([_less(u + v), (u + np.uint64(P) - v) * roots(half, False) % np.uint64(P)], axis=1)
        half //= 2
    return a.reshape(n, columns)


def restored(a: np.ndarray) -> np.ndarray:
    """Inverse of transformed()."""
    n, columns = a.shape
    half = 1
    while half < n:
        a = a.reshape(-1, 2, half, columns)
        u, v = a[:, 0], a[:, 1] * roots(half, True) % np.uint64(P)
        a = np.stack([_less(u + v), _less(u + np.uint64(P) - v)], axis=1)
        half *= 2
    return a.reshape(n, columns) * np.uint64(pow(n, -1, P)) % np.uint64(P)


def occurrences(symbols: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and distance (size <= distance < 2 * size) of all places where symbols[begin : begin + size] stand again.

    symbols are so small that every sum is an integer below P; they reach to begin + 3 * size.
    """
    found = [], []
    step = max(1, CELLS // (2 * size))
    for at in range(0, len(begin), step):
        b = begin[at : at + step]
        block = symbols[b + np.arange(size)[:, None]]
        behind = symbols[b + np.arange(size, 3 * size)[:, None]]
        behind[-1] = 0
        own = (block * block).sum(axis=0)
        squares = np.concatenate([np.zeros((1, len(b)), np.uint64), np.cumsum(behind * behind, axis=0)])
        there = squares[size : 2 * size] - squares[:size]
        turned = np.zeros((2 * size, len(b)), np.uint64)
        turned[:size] = block[::-1]
        cross = restored(transformed(turned) * transformed(behind) % np.uint64(P))[size - 1 : 2 * size - 1]
        distance, which = np.nonzero(own + there == 2 * cross)
        found[0].append(b[which])
        found[1].append(distance + size)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def extended(x: np.ndarray, begin: int, distance: int, least: int) -> tuple[int, int]:
    """The longest stretch around `begin` whose words `distance` apart are equal (empty if those at begin aren't)."""
    end, step = begin, least
    while end + distance < len(x):
        a, b = x[end : end + step], x[end + distance : end + distance + step]
        differs = a[: len(b)] != b
        k = int(differs.argmax())
        if differs[k]:
            end += k
            break
        end += len(b)
        step *= 2
    start, step = begin, least
    while start > 0:
        low = max(0, start - step)
        differs = (x[low:start] != x[low + distance : start + distance])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            start -= k
            break
        start = low
        step *= 2
    return start, end + distance


class Known:
    """Runs found so far. Two of them that share p + q words are one, so the one that reaches furthest is the only one to ask."""

    def __init__(self):
        self.runs: dict[tuple[int, int], int] = {}

    def ready(self) -> None:
        spans = np.array(sorted(self.runs), np.int64).reshape(-1, 2)
        self.start = spans[:, 0]
        self.end = np.maximum.accumulate(spans[:, 1])

    def cover(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(begin), bool)
        at = np.searchsorted(self.start, begin, side="right") - 1
        return (at >= 0) & (self.end[at] >= end)


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs in a sequence of word numbers, by start and period; longest: no run is longer than that.

    Numbers that stand once, such as separators of documents, end every run.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = words[order[1:]] == words[order[:-1]]
    reach = np.full(n, np.iinfo(np.int64).max)
    reach[order[:-1][again]] = (order[1:] - order[:-1])[again]
    spread = mixed(words.astype(np.uint64) + np.uint64(1))
    known, scale = Known(), 0
    while LEAST_TIMES << scale <= longest:
        size = 1 << scale
        begin = np.flatnonzero(reach < 2 * size) * size
        known.ready()
        begin = begin[~known.cover(begin, begin + 3 * size - 1)]
        symbols = spread >> np.uint64(64 - (30 - scale) // 2)
        at, distance = occurrences(np.append(symbols, np.zeros(3 * size, np.uint64)), begin, size)
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        pair = (at[1:] == at[:-1] + size) & (distance[1:] == distance[:-1]) if len(at) else np.zeros(0, bool)
        at, distance = at[:-1][pair], distance[:-1][pair]
        fresh = ~known.cover(at, at + distance + size)
        behind, last = -1, 0
        for b, d in zip(at[fresh].tolist(), distance[fresh].tolist(), strict=True):
            if d == last and b + d + size <= behind:
                continue  # in the stretch that was looked at last
            start, end = extended(words, b, d, 2 * size)
            behind, last = end, d
            if end - start >= max(LEAST_LENGTH, LEAST_TIMES * d):
                known.runs.setdefault((start, end), d)
        whole = len(reach) // 2 * 2
        reach = np.maximum(reach[:whole:2], reach[1:whole:2])
        scale += 1
    found = np.array([(s, e, d) for (s, e), d in known.runs.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal ones alike, with a number of its own before each document and behind the last; the place of each word."""
    size = w.end - w.start
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.raw[w.inside]))])
    coded = words.dictionary_encode()
    docs = len(w.count)
    place = np.arange(len(size)) + w.doc + 1
    out = np.arange(len(size) + docs + 1) + len(coded.dictionary)
    out[place] = coded.indices.to_numpy()
    return out, place


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every document.

    A run is a stretch of consecutive words with smallest period q, of at least 4 * q and 6 words, that can't be made longer with
    that period; runs come by start, then period. The collapsed text has all words, joined by one space, but those that stand in any run
    behind its first period. Words are runs of other characters than space and the controls 9 to 13. A null or empty text has no
    words, no runs and an empty collapsed text; rows that repeat, or have no doc_id, are documents of their own; other columns are
    ignored. Documents are looked at where they are, nothing is shuffled; memory is that of a text of some megabytes, or of the longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            off, _ = text_bytes(whole.column(1))
            for lo, hi in slices(np.diff(off) + 32, SLICE_BYTES):
                yield collapsed(whole.slice(lo, hi - lo))
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def collapsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = Words(*text_bytes(batch.column(1)))
    numbers, place = numbered(w)
    found = runs_of(numbers, int(w.count.max(initial=0)))
    start = np.searchsorted(place, found[:, 0])
    length, period = found[:, 1] - found[:, 0], found[:, 2]
    gone = np.zeros(len(place) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    doc = w.doc[start] if len(start) else start
    runs = pa.StructArray.from_arrays([pa.array(start - (w.last - w.count)[doc]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(w.count))))
    text = joined_words(w, np.cumsum(gone)[:-1] == 0).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.count), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), text], names=["doc_id", "n_words", "runs", "collapsed"])


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text of ten repeats itself: with h = crc32(doc_id), g = h / 10 and n words, if h % 10 is 0, the words from
    a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, found).alias("words"))
    placed = words.select("doc_id", "text", "g", "words", F.size("words").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    looped = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), looped), " ")).otherwise(F.col("text")).alias("text"))
