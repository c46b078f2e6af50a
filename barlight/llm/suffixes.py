"""Substring removal by bucket-pointer refinement of byte positions.

A position's first bucket is that of its q-gram; a bucket is refined by the bucket identifiers at later offsets: the identifier of a
run of a + b bytes is made of those of its first a bytes and of the b bytes that start a later, used again for every longer run.
Identifiers are 64-bit hashes, so they mean the same in every task and equal strings need no common sort.

Only some positions are put into buckets. The anchor of a `width`-byte string is the least identifier of its q-grams, so
equal strings have equal anchors:

1. Anchors are sorted into buckets over the whole corpus; those of a single document are settled.
2. An anchor's bucket is refined to its stretch, all strings that have this anchor, by the identifiers at its first and last
   string. Where a stretch also occurs in a document with a smaller id, all of it goes.
3. Where an anchor's bucket holds several stretches, their first occurrences are refined to single strings, and a string goes
   if it starts in a document with a smaller id.

Of each bucket a block of documents sends one entry, with its smallest doc_id, so a group of copies costs as much as one of them
for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm import blocks as B
from barlight.llm.common import GOLD, Sums, byte_table, mixed, sliding_min, text_bytes
from barlight.llm.phrases import runs

BLOCK_BYTES = 2_000_000
PLACE_BITS = 28
PIECE = 1 << 17
NO_ID = -(2**63)  # rows without doc_id come before all others


class Positions:
    """Anchors, stretches and strings of a block's texts."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, width: int):
        self.off, self.raw = text_bytes(texts)
        n, self.width, q = len(self.raw), width, width // 2
        if n >> PLACE_BITS:
            raise ValueError("a block has too many bytes")
        self.sums = Sums(byte_table(7)[self.raw])
        # Strings with the same anchor follow each other: a stretch is such a run of starts within one text. Anchors are looked
        # for in pieces that fit the processor's cache.
        place = np.uint64((1 << PLACE_BITS) - 1)
        total = max(0, n - width + 1)
        new, anchor = np.empty(total, bool), np.empty(total, np.uint32)
        for a in range(0, total, PIECE):
            b = min(total, a + PIECE)
            keys = self.sums.between(a, b + width - q, q)
            keys ^= keys >> np.uint64(32)
            keys *= np.uint64(0xD6E8FEB86659FD93)
            keys &= ~place
            keys |= np.arange(a, b + width - q, dtype=np.uint64)
            anchor[a:b] = sliding_min(keys, width - q + 1)[: b - a] & place
        if total:
            new[0] = True
            np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        fits = np.maximum(np.diff(self.off) - width + 1, 0)
        starts = self.off[:-1][fits > 0]
        new[starts] = True
        self.first = np.flatnonzero(new)
        self.doc = np.searchsorted(self.off, self.first, side="right") - 1
        stop = np.minimum(np.append(self.first[1:], n), (self.off[:-1] + fits)[self.doc])
        whole = stop > self.first  # else the strings would reach into the next text
        self.first, self.doc = self.first[whole], self.doc[whole]
        self.count = stop[whole] - self.first
        self.last = self.first + self.count - 1
        place_of = anchor[self.first].astype(np.int64)
        self.id = ids[self.doc]
        self.anchor = mixed(self.sums.at(place_of, q) ^ np.uint64(0x5851F42D4C957F2D))
        shape = self.count.astype(np.uint64) * np.uint64(1 << 20) + (place_of - self.first).astype(np.uint64)
        self.stretch = mixed(self.string(self.first) * np.uint64(GOLD) + mixed(self.string(self.last) + shape * np.uint64(0xD6E8FEB86659FD93)))

    def string(self, start: np.ndarray) -> np.ndarray:
        """Identifiers of the strings at these starts: that of the first q-gram refined by that of what follows it."""
        q = self.width // 2
        rest = self.width - q
        return mixed(self.sums.at(start, q) * self.sums.power[rest] + self.sums.at(start + q, rest))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by all keys, the first one foremost, and the group number of each sorted row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def least(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Smallest value of each group; groups are numbered in order."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
    return np.minimum.reduceat(values, begin) if len(group) else values


class Anchors:
    """Round one: a block's distinct anchors, and whether several of its documents have them."""

    def __init__(self, p: Positions):
        self.order, self.group = grouped(p.anchor, p.id)[0], None
        a = p.anchor[self.order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        self.hashes = a[new]
        ids = p.id[self.order]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(a)) - 1
        self.several = ids[begin] != ids[end] if len(a) else new
        self.of = np.empty(len(a), np.int64)
        self.of[self.order] = self.group


class Stretches:
    """Round two: distinct (bucket, anchor, stretch) of stretches whose anchor recurs, with the smallest doc_id that has them here."""

    def __init__(self, p: Positions, anchors: Anchors, answer: np.ndarray):
        answer = answer[anchors.of]
        self.rows = np.flatnonzero(answer & 1)
        a, s = p.anchor[self.rows], p.stretch[self.rows]
        hot = (answer[self.rows] & 2) > 0
        route = np.where(hot, mixed(a ^ s), a)  # a very common anchor's stretches go to many buckets
        order, group = grouped(route, a, s)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        self.route, self.a, self.s, self.hot = (x[order][begin] for x in (route, a, s, hot))
        self.id = least(p.id[self.rows][order], group)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group

    def messages(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        found = []
        for bucket, i, j in B.spread(self.route, buckets):
            part = slice(i, j)
            found.append((bucket, B.squeezed(B.differences(self.a[part]), self.s[part], self.id[part], self.hot[part].astype(np.uint8))))
        return B.messages(block, found)


def first_stretches(data: list[bytes]) -> list[bytes]:
    """For each stretch: 1 if a document with a smaller id than the block's smallest has it; 2 if its strings must be looked at."""
    parts = [B.unsqueezed(d, np.uint64, np.uint64, np.int64, np.uint8) for d in data]
    a = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    s, ids, hot = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
    order, group = grouped(a, s)
    smallest = least(ids[order], group)[group]
    earlier = smallest < ids[order]
    # Does the anchor's bucket hold stretches that first occur in different documents? Then their strings are compared.
    sorted_a = a[order]
    begin = np.flatnonzero(np.append(True, sorted_a[1:] != sorted_a[:-1])) if len(order) else order
    size = np.diff(np.append(begin, len(order)))
    low, high = (np.repeat(f.reduceat(smallest, begin), size) for f in (np.minimum, np.maximum)) if len(order) else (smallest, smallest)
    look = ~earlier & ((low != high) | (hot[order] > 0))
    answer = np.empty(len(order), np.uint8)
    answer[order] = earlier + 2 * look
    return B.split_answer(answer, [len(x[0]) for x in parts])


class Strings:
    """Round three: distinct strings of the first occurrences of stretches that must be looked at, with the smallest doc_id here."""

    def __init__(self, p: Positions, stretches: Stretches, answer: np.ndarray):
        of = stretches.of
        first = p.id[stretches.rows] == stretches.id[of]
        self.gone = stretches.rows[(answer[of] & 1).astype(bool) | ~first]  # whole stretches
        rows = stretches.rows[(answer[of] & 2).astype(bool) & first]
        count = p.count[rows]
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.starts = np.repeat(p.first[rows], count) + inside
        self.ids = np.repeat(p.id[rows], count)
        h = p.string(self.starts)
        order, group = grouped(h)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        self.hashes = h[order][begin]
        self.id = least(self.ids[order], group)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group

    def messages(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        found = [(bucket, B.squeezed(B.differences(self.hashes[i:j]), self.id[i:j])) for bucket, i, j in B.spread(self.hashes, buckets)]
        return B.messages(block, found)

    def covered(self, p: Positions, answer: np.ndarray) -> np.ndarray:
        """Mask of the bytes that go."""
        step = np.zeros(len(p.raw) + 1, np.int64)
        np.add.at(step, p.first[self.gone], 1)
        np.add.at(step, p.last[self.gone] + p.width, -1)
        hit = self.starts[(answer[self.of] > 0) | (self.ids > self.id[self.of])]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + p.width, -1)
        return np.cumsum(step)[: len(p.raw)] > 0


def earlier_strings(data: list[bytes]) -> list[bytes]:
    parts = [B.unsqueezed(d, np.uint64, np.int64) for d in data]
    h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    ids = np.concatenate([x[1] for x in parts])
    order, group = grouped(h)
    answer = np.empty(len(h), np.uint8)
    answer[order] = least(ids[order], group)[group] < ids[order]
    return B.split_answer(answer, [len(x[0]) for x in parts])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _cut(docs: DataFrame, width: int, finish, schema) -> DataFrame:
    """Apply finish(documents, positions, mask of removed bytes) to every block."""
    blocks = B.packed(docs, BLOCK_BYTES)
    buckets = B.bucket_count(blocks)

    def positions(batch) -> Positions:
        return Positions(batch.column(batch.schema.get_field_index("text")), _ids(batch), width)

    def ask_anchors(block, batch, _) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(positions(batch))
        return B.hash_messages(block, anchors.hashes, anchors.several, buckets, drop_bits=16)

    def second(p: Positions, answers) -> Stretches:
        anchors = Anchors(p)
        return Stretches(p, anchors, B.gathered(answers[0], len(anchors.hashes)))

    def ask_stretches(block, batch, answers) -> Iterator[pa.RecordBatch]:
        return second(positions(batch), answers).messages(block, buckets)

    def third(p: Positions, answers) -> Strings:
        stretches = second(p, answers)
        return Strings(p, stretches, B.gathered(answers[1], len(stretches.a)))

    def ask_strings(block, batch, answers) -> Iterator[pa.RecordBatch]:
        return third(positions(batch), answers).messages(block, buckets)

    def cut(block, batch, answers) -> Iterator[pa.RecordBatch]:
        p = positions(batch)
        strings = third(p, answers)
        yield finish(batch, p, strings.covered(p, B.gathered(answers[2], len(strings.hashes))))

    anchors = B.asked(blocks, ask_anchors, B.met_elsewhere)
    stretches = B.asked(B.with_answers(blocks, anchors), ask_stretches, first_stretches)
    strings = B.asked(B.with_answers(blocks, anchors, stretches), ask_strings, earlier_strings)
    return B.each_block(B.with_answers(blocks, anchors, stretches, strings), cut, schema)


def _kept(p: Positions, gone: np.ndarray) -> list[bytes]:
    left = p.raw[~gone].tobytes()
    ends = np.append(0, np.cumsum(~gone))[p.off].tolist()
    return [left[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def without_earlier_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and length of removed runs, in bytes) and kept (bytes) of every text.

    A byte goes if a `width`-byte string that covers it also starts in a document with a smaller doc_id. Strings are those of the input,
    in UTF-8, within one document. Rows with the same doc_id take nothing from each other; rows without one count as before all
    others. A null text is empty; other columns are ignored.
    """

    def finish(batch, p: Positions, gone: np.ndarray) -> pa.RecordBatch:
        n = batch.num_rows
        size = np.diff(p.off)
        owner = np.repeat(np.arange(n), size)
        removed = np.bincount(owner[gone], minlength=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(removed), runs(gone, owner, n, p.off[:-1]), pa.array(_kept(p, gone), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(rows, width, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept binary")


def trimmed(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with the same columns and shorter texts. Bytes of a character that was cut in two go as a whole; a null text stays null."""
    names = docs.columns
    at = names.index("text")

    def finish(batch, p: Positions, gone: np.ndarray) -> pa.RecordBatch:
        texts = [k.decode("utf-8", "ignore") for k in _kept(p, gone)]
        old = batch.column(at)
        texts = pa.array([t if known else None for t, known in zip(texts, old.is_valid().to_pylist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return _cut(docs, width, finish, docs.schema)
