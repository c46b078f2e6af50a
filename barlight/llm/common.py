"""Helpers shared by the operators: Arrow text as numpy arrays, word and gram hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about the limit; a single larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (an invertible mix)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def byte_table(seed: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * np.uint64(GOLD))


def rolled(values: np.ndarray, width: int, base: int = GOLD) -> np.ndarray:
    """Polynomial hash of every run of `width` values, doubled up from the hashes of shorter runs.

    H(a + b) at i is H(a) at i times base**b plus H(b) at i + a. The last width - 1 entries reach over the end
    and mean nothing.
    """
    n = len(values)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[: max(0, n - by)] = x[by:]
        return out

    power, have = values, 1
    out, done = None, 0
    while True:
        if width & have:
            if out is None:
                out, done = power, have
            else:  # the longer run first, what was gathered so far behind it
                out = power * np.uint64(pow(base, done, 1 << 64)) + shifted(out, have)
                done += have
        if have * 2 > width:
            return out
        power = power * np.uint64(pow(base, have, 1 << 64)) + shifted(power, have)
        have *= 2


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """GOLD ** i and its inverse modulo 2**64 for i < n; the longest tables so far are kept."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((GOLD, pow(GOLD, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.cumprod(table)
    return _POWERS[0][:n], _POWERS[1][:n]


class Sums:
    """Polynomial hashes of runs of any length from prefix sums; hash(i, w) equals rolled(values, w)[i]."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.power, inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * inverse[: self.n], out=self.sums[1:])

    def between(self, begin: int, end: int, width: int) -> np.ndarray:
        """Hashes of the runs that start at begin .. end - 1."""
        out = self.sums[begin + width : end + width] - self.sums[begin:end]
        out *= self.power[begin + width - 1 : end + width - 1]
        return out

    def at(self, start: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[start + width] - self.sums[start]) * self.power[start + width - 1]


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum over keys[i : i + width]; entries whose window reaches over the end take what is there."""
    n, have, low = len(keys), 1, keys.copy()
    while have * 2 <= width:
        if have < n:
            np.minimum(low[: n - have], low[have:], out=low[: n - have])
        have *= 2
    rest = width - have
    if rest and rest < n:
        out = low.copy()
        np.minimum(low[: n - rest], low[rest:], out=out[: n - rest])
        return out
    return low


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, or runs of the bytes marked in a table of 256, as byte spans and 64-bit hashes."""

    def __init__(self, off: np.ndarray, raw: np.ndarray, fold_case: bool = False, word_bytes: np.ndarray | None = None):
        if fold_case:
            upper = (raw >= 65) & (raw <= 90)
            raw = np.where(upper, raw + 32, raw).astype(np.uint8)
        self.raw = raw
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) if word_bytes is None else word_bytes[raw]
        n = len(raw)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
        edges = off[:-1][off[:-1] < n]
        first[edges] = True
        last[off[1:][off[1:] > 0] - 1] = True
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(off) - 1).astype(np.int64)
        self.last = np.cumsum(self.count)  # one behind each document's last word
        self.inside = inside

    def hashes(self, seed: int = 1) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begins = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int32)
        place -= np.repeat(begins.astype(np.int32), size)
        values = np.cumprod(np.full(int(size.max()) + 1, GOLD, np.uint64))[place]
        del place
        values *= byte_table(seed)[self.raw[self.inside]]
        return mixed(np.add.reduceat(values, begins) + size.astype(np.uint64))

    def whole(self, width: int) -> np.ndarray:
        """True where a run of `width` words that starts here lies within its document."""
        return np.arange(len(self.start)) + width <= self.last[self.doc] if len(self.start) else np.zeros(0, bool)


def joined_words(w: Words, stays: np.ndarray) -> pa.Array:
    """The marked words of each text, joined by one space."""
    size, doc = (w.end - w.start)[stays], w.doc[stays]
    lead = np.append(False, doc[1:] == doc[:-1])[: len(doc)]
    total = size + lead
    begin = np.cumsum(total) - size
    out = np.full(int(total.sum()), 32, np.uint8)
    filled = np.ones(len(out), bool)
    filled[(begin - 1)[lead]] = False
    out[filled] = w.raw[w.inside][np.repeat(stays, w.end - w.start)]
    ends = np.append(0, np.cumsum(np.bincount(doc, weights=total, minlength=len(w.count)))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(w.count), pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes()))


def spark_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
