"""Document fingerprints by winnowing.

Hashes of all runs of `gram` code points; from every window of `window` successive hashes the smallest is kept, the rightmost
of equal ones. Two texts that share a passage of gram + window - 1 code points share at least one kept hash, and the
positions tell where. A text with fewer hashes than a window keeps the smallest of what it has; one shorter than a gram
is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.common import GOLD, mixed, rolled, slices, sliding_min

SLICE_CHARS = 400_000
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Winnow:
    gram: int = 16
    window: int = 32

    def select(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, position and 32-bit hash of every kept gram, in order. codes: all texts' code points in a row."""
        n, docs = len(codes), len(off) - 1
        size = np.diff(off)
        none = np.zeros(0, np.int64)
        if not n:
            return none, none, np.zeros(0, np.uint32)
        values = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLD))
        hashes = (mixed(rolled(values, self.gram)) >> np.uint64(32)).astype(np.uint64)
        doc = np.repeat(np.arange(docs), size)
        place = np.arange(n) - off[:-1][doc]
        grams = np.maximum(size - self.gram + 1, 0)
        # The low half of a key falls as the position grows, so the least key is the rightmost of equal hashes.
        keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place.astype(np.uint64))
        keys[place >= grams[doc]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = sliding_min(keys, self.window)
        # Windows of a text start at 0 .. grams - window, one at least where there is a gram; keys beyond its grams are the largest.
        windows = np.maximum(grams - self.window + 1, (grams > 0).astype(np.int64))
        starts = place < windows[doc]
        chosen, owner = least[starts], doc[starts]
        few = (grams > 0) & (grams < self.window)
        if few.any():  # their window would reach into the next text
            begin = off[:-1][few]
            reach = np.minimum.reduceat(np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)), np.stack([begin, begin + grams[few]], 1).ravel())[::2]
            chosen[np.searchsorted(owner, np.flatnonzero(few))] = reach
        new = np.ones(len(chosen), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        chosen, owner = chosen[new], owner[new]
        at = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
        kept = (chosen >> np.uint64(32)).astype(np.uint32)
        short = np.flatnonzero((size > 0) & (grams == 0))
        if len(short):
            whole = np.array([self._whole(codes[off[d] : off[d + 1]]) for d in short], np.uint32)
            owner, at, kept = np.concatenate([owner, short]), np.concatenate([at, np.zeros(len(short), np.int64)]), np.concatenate([kept, whole])
            order = np.argsort(owner, kind="stable")
            owner, at, kept = owner[order], at[order], kept[order]
        return owner, at, kept

    @staticmethod
    def _whole(codes: np.ndarray) -> int:
        return int.from_bytes(hashlib.blake2b(codes.astype("<u4").tobytes(), digest_size=4).digest(), "little")


def as_text(docs: int, owner: np.ndarray, at: np.ndarray, kept: np.ndarray) -> list[str]:
    """Ten hexadecimal digits for each kept gram: eight of the hash, two of the distance from the kept gram before."""
    step = at.copy()
    same = np.zeros(len(at), bool)
    same[1:] = owner[1:] == owner[:-1]
    step[1:][same[1:]] -= at[:-1][same[1:]]
    raw = np.empty((len(at), 5), np.uint8)
    raw[:, :4] = kept.astype(">u4").view(np.uint8).reshape(-1, 4)
    raw[:, 4] = step
    text, ends = raw.tobytes().hex(), 10 * np.cumsum(np.bincount(owner, minlength=docs))
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], docs: int) -> np.ndarray:
    """Shared share of the distinct hashes of each pair of fingerprints; two empty ones are alike, one empty is not."""
    keys = [np.unique((owner.astype(np.uint64) << np.uint64(32)) | kept.astype(np.uint64)) for owner, kept in (left, right)]
    both = np.intersect1d(*keys, assume_unique=True)
    count = [np.bincount((k >> np.uint64(32)).astype(np.int64), minlength=docs) for k in (*keys, both)]
    union = count[0] + count[1] - count[2]
    return np.where(union > 0, count[2] / np.maximum(union, 1), 1.0)


def fingerprints(docs: DataFrame, winnow: Winnow = Winnow()) -> DataFrame:
    """doc_id, n_chars and the kept grams (position, hash) of every text; a null text is empty and keeps none."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("grams", pa.list_(pa.struct([("position", pa.int64()), ("hash", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            for a, b in slices(sizes, SLICE_CHARS):
                off, codes = _codes(texts[a:b])
                owner, at, kept = winnow.select(codes, off)
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=b - a)))
                grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(kept.astype(np.int64))], names=["position", "hash"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes[a:b]), grams], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_chars bigint, grams array<struct<position:bigint,hash:bigint>>")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return off, np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_grams", pa.int64())])


def with_successor(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """block, halo, doc_id, text: documents dealt out by ranges of doc_id, each range closed by the first document of the next.

    Ranges begin at ids that occur; the last is closed by the first document of all. Rows without doc_id come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.count("*"), F.sum(F.length("text").cast("long")), F.min("doc_id"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    blocks = max(1, -(-(size[1] or 0) // block_chars), -(-size[0] // 100_000))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    # The first range starts at the least id (or holds the rows without one); a list of one number for each block.
    bounds = np.array(sorted({c for c in cuts or [] if c > size[2]}), np.int64)
    last, nulls, least = len(bounds), bool(size[3]), size[2]
    schema = pa.schema([("block", pa.int32()), ("halo", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy()
            block = np.where(known, np.searchsorted(bounds, values, side="right"), 0).astype(np.int32)
            first = ~known if nulls else known & (values == least)
            extra = np.flatnonzero(known & np.isin(values, bounds))
            wrap = np.flatnonzero(first)
            row = np.concatenate([np.arange(len(values)), extra, wrap])
            target = np.concatenate([block, block[extra] - 1, np.full(len(wrap), last)]).astype(np.int32)
            halo = np.concatenate([np.zeros(len(values)), np.ones(len(extra)), np.full(len(wrap), 2)]).astype(np.int32)
            moved = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(halo), moved.column(0), moved.column(1)], schema=schema)

    dealt = rows.mapInArrow(deal, "block int, halo int, doc_id bigint, text string")
    return dealt.repartition(last + 1, "block").sortWithinPartitions("block", "halo", F.asc_nulls_first("doc_id"), "text")


def compare_with_edits(docs: DataFrame, winnow: Winnow = Winnow(), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Fingerprints of every text and of an edited text, whose last quarter is replaced from the next document.

    The next document is the one with the next larger doc_id, then text; after the last comes the first. A single document
    is its own successor. Memory: a slice of SLICE_CHARS code points, or one document with its successor.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    def groups(batches) -> Iterator[tuple[list, list[str]]]:
        """Ids of some documents in a row, and their texts with that of the document behind the last."""
        ids, texts, chars, block, closed = [], [], 0, None, False
        for b, halo, doc_id, text in rows(batches):
            if b != block:
                block, closed = b, False
                ids, texts, chars = [], [], 0
            if closed:
                continue
            texts.append(text)
            chars += len(text)
            if halo:
                closed = True
                if ids:
                    yield ids, texts
                ids, texts, chars = [], [], 0
            else:
                if chars > SLICE_CHARS and ids:
                    yield ids, texts
                    ids, texts, chars = [], [text], len(text)
                ids.append(doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches):
            n = len(ids)
            edited = []
            for text, following in zip(texts, texts[1:], strict=False):
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + following[:cut])
            # The texts, the one behind them, then the edited ones.
            owner, at, kept = winnow.select(*reversed(_codes(texts + edited)))
            strings = as_text(2 * n + 1, owner, at, kept)
            own, late = owner < n, owner > n
            after = (owner > 0) & (owner <= n)
            mine = (owner[own], kept[own])
            near_edited = likeness(mine, (owner[late] - n - 1, kept[late]), n)
            near_next = likeness(mine, (owner[after] - 1, kept[after]), n)
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(digest), pa.array(strings[:n]), pa.array(strings[n + 1 :]), pa.array(near_edited), pa.array(near_next), pa.array(np.bincount(owner[own], minlength=n).astype(np.int64))], schema=COMPARED)

    return with_successor(docs, block_chars).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_grams bigint")
