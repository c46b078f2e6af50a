"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of `width` words; an item of fewer words is one window. Windows of equal length m share a table: the
search looks at the last pair of words of a place where a window might stand, and the shift of that pair (by its hash) says how many words no
window can end in, up to m - 1. Where the shift is 0, the windows with the hash of that pair, and of the pair that the window would
begin with, are the bucket; they are compared byte by byte. Many stretches of text are searched side by side, one step of all of them at a time.

Compiled tables hold a bounded piece of the benchmark each (SHARD_BYTES) and are broadcast one after the other; documents are not
shuffled. A benchmark of one shard, the usual case, takes a single pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.blocks import release_memory
from barlight.llm.common import GOLD, Words, mixed, slices, text_bytes
from barlight.session import staged

SHARD_BYTES = 16_000_000  # of item words in one compiled table
CHUNK_WINDOWS = 4096  # of one item that stay together
SLICE_BYTES = 4_000_000  # of text searched at a time; a longer text stands alone
LANE = 512  # words of a stretch that is searched on its own
WORD_BYTES = np.array([b >= 128 or chr(b).isdigit() or 97 <= b <= 122 for b in range(256)])  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] in lower case
CHUNKS = "item_id bigint, shard int, m int, text string"
FOUND = "row bigint, doc_id bigint, n_words bigint, spans array<struct<start:bigint,length:bigint>>, items array<bigint>"
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


class Spaced:
    """The words of some texts, lower-cased, written one after the other with a space behind each."""

    def __init__(self, texts):
        w = Words(*text_bytes(texts), fold_case=True, word_bytes=WORD_BYTES)
        size = w.end - w.start
        self.doc, self.count, self.last, self.hash = w.doc, w.count, w.last, w.hashes()
        self.begin = np.append(0, np.cumsum(size + 1))
        self.text = np.full(int(self.begin[-1]), 32, np.uint8)
        filled = np.ones(len(self.text), bool)
        filled[self.begin[1:] - 1] = False
        self.text[filled] = w.raw[w.inside]

    def pairs(self, m: int) -> np.ndarray:
        """Hash of the word pair that starts at each word; of the word alone, if windows have a single word."""
        if m == 1:
            return mixed(self.hash)
        return mixed(self.hash[:-1] * np.uint64(GOLD) + self.hash[1:]) if len(self.hash) else self.hash


def chunks(items: DataFrame, width: int, shards: int) -> DataFrame:
    """item_id, shard, window length and words (each with a space behind) of pieces of the items that hold all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Spaced(batch.column(1))
            out = []
            for row, (item, n, last) in enumerate(zip(batch.column(0).to_pylist(), w.count.tolist(), w.last.tolist(), strict=True)):
                m = min(width, n)
                for k, at in enumerate(range(last - n, last - m + 1 if n else 0, CHUNK_WINDOWS)):
                    stop = min(at + CHUNK_WINDOWS + m - 1, last)
                    out.append((item, int(mixed(np.array([hash((item, row if item is None else 0, k)) & (2**63 - 1)], np.uint64))[0] % np.uint64(shards)), m, w.text[w.begin[at] : w.begin[stop]].tobytes().decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["item_id", "shard", "m", "text"])

    return items.mapInArrow(run, CHUNKS)


@dataclass
class Table:
    """The windows of one length. Pattern p has the bytes text[begin[p] : end[p]] and the items items[item_from[p] : item_from[p + 1]]."""

    m: int
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    item_from: np.ndarray
    items: np.ndarray
    shift: np.ndarray  # by the leading bits of a pair's hash
    bucket: np.ndarray  # sorted distinct hashes of last and first pair together
    bucket_from: np.ndarray  # places in `order`, one more than buckets
    order: np.ndarray  # patterns, bucket after bucket

    @property
    def block(self) -> int:
        return min(2, self.m)


def compiled(m: int, item_ids: list, texts: list[str]) -> Table:
    """The table of all windows of m words of the given pieces of items."""
    w = Spaced(pa.array(texts, pa.large_string()))
    start = np.flatnonzero(np.arange(len(w.doc)) + m <= w.last[w.doc])
    begin, end = w.begin[start], w.begin[start + m]
    pairs = w.pairs(m)
    block = min(2, m)
    whole = w.hash[start]
    for j in range(1, m):
        whole = mixed(whole * np.uint64(GOLD) + w.hash[start + j])
    item = np.array([-1 if i is None else i for i in item_ids], np.int64)[w.doc[start]]
    known = np.array([i is not None for i in item_ids], bool)[w.doc[start]]
    pattern = distinct(whole, begin, end, w.text)
    first = np.unique(pattern, return_index=True)[1]
    # Items of each pattern, each once; those without an id are found but not listed.
    listed = np.unique(np.stack([pattern[known], item[known]]), axis=1)
    item_from = np.append(0, np.cumsum(np.bincount(listed[0], minlength=len(first)))).astype(np.int64)
    start, begin, end = start[first], begin[first], end[first]
    bits = max(10, min(22, int(np.ceil(np.log2(len(start) * m + 1))) + 2))
    shift = np.full(1 << bits, m - block + 1, np.uint8 if m < 250 else np.int32)
    for j in range(m - block + 1):  # later pairs last: they have the smaller shift
        shift[slot(pairs[start + j], bits)] = m - block - j
    ends = both_ends(pairs, start, m - block)
    order = np.argsort(ends, kind="stable")
    bucket, bucket_from = np.unique(ends[order], return_index=True)
    return Table(m, w.text, begin, end, item_from, listed[1], shift, bucket, np.append(bucket_from, len(order)), order)


def both_ends(pairs: np.ndarray, start: np.ndarray, lead: int) -> np.ndarray:
    """Hash of the last and the first pair of the windows that start there."""
    return mixed(pairs[start + lead] * np.uint64(GOLD) + pairs[start])


def slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (pairs >> np.uint64(64 - bits)).astype(np.int64)


def distinct(whole: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Number of the pattern that each window is: windows are one pattern if their bytes are equal, not just their hashes."""
    pattern, open_, used = np.zeros(len(whole), np.int64), np.arange(len(whole)), 0
    while len(open_):
        _, first, of = np.unique(whole[open_], return_index=True, return_inverse=True)
        own = open_[first][of]
        same = equal(text, begin[open_], end[open_], text, begin[own], end[own])
        pattern[open_[same]] = used + of[same]
        used += len(first)
        open_ = open_[~same]
    return np.unique(pattern, return_inverse=True)[1]


def equal(a: np.ndarray, begin_a: np.ndarray, end_a: np.ndarray, b: np.ndarray, begin_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Whether a[begin_a : end_a] and b[begin_b : end_b] are the same bytes, for arrays of spans."""
    same = end_a - begin_a == end_b - begin_b
    rows = np.flatnonzero(same)
    for lo, hi in slices(end_a[rows] - begin_a[rows], 1_000_000):
        part = rows[lo:hi]
        size = end_a[part] - begin_a[part]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differs = a[np.repeat(begin_a[part], size) + place] != b[np.repeat(begin_b[part], size) + place]
        same[np.repeat(part, size)[differs]] = False
    return same


def search(table: Table, w: Spaced) -> tuple[np.ndarray, np.ndarray]:
    """First word and pattern of every occurrence of the table's windows in the documents."""
    m, block = table.m, table.block
    pairs = w.pairs(m)
    lead = m - block  # words before the last pair
    bits = int(np.log2(len(table.shift)))
    shifts = table.shift[slot(pairs, bits)] if len(pairs) else np.zeros(0, np.int64)
    place = np.arange(lead, len(pairs), LANE)
    stop = np.minimum(place + LANE, len(pairs))
    halts = []
    while len(place):
        step = shifts[place].astype(np.int64)
        halts.append(place[step == 0])
        place = place + np.maximum(step, 1)
        going = place < stop
        place, stop = place[going], stop[going]
    at = np.concatenate(halts) if halts else np.zeros(0, np.int64)
    at = at[w.doc[at - lead] == w.doc[at + block - 1]]  # a place within one document
    start = at - lead
    ends = both_ends(pairs, start, lead)
    bucket = np.minimum(np.searchsorted(table.bucket, ends), len(table.bucket) - 1)
    met = table.bucket[bucket] == ends
    start, bucket = start[met], bucket[met]
    starts, patterns = [], []
    size = table.bucket_from[bucket + 1] - table.bucket_from[bucket]
    for lo, hi in slices(size, 1_000_000):
        s = np.repeat(start[lo:hi], size[lo:hi])
        inside = np.arange(len(s)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])
        p = table.order[np.repeat(table.bucket_from[bucket[lo:hi]], size[lo:hi]) + inside]
        same = equal(w.text, w.begin[s], w.begin[s + m], table.text, table.begin[p], table.end[p])
        starts.append(s[same])
        patterns.append(p[same])
    return (np.concatenate(starts), np.concatenate(patterns)) if starts else (start, start)


def scanned(docs: DataFrame, tables, all_rows: bool) -> DataFrame:
    """row, doc_id, n_words, hit spans (in words) and items found of each document under broadcast tables; or of those with hits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables.value
        for whole in batches:
            off, _ = text_bytes(whole.column(2))
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                yield hits(whole.slice(lo, hi - lo), own, all_rows)
            release_memory()

    return docs.select("row", "doc_id", "text").mapInArrow(run, FOUND)


def hits(batch: pa.RecordBatch, tables: list[Table], all_rows: bool) -> pa.RecordBatch:
    w = Spaced(batch.column(2))
    step = np.zeros(len(w.doc) + 1, np.int64)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in tables:
        start, pattern = search(t, w)
        np.add.at(step, start, 1)
        np.add.at(step, start + t.m, -1)
        pair = np.unique(np.stack([w.doc[start], pattern]), axis=1)
        for lo, hi in slices(t.item_from[pair[1] + 1] - t.item_from[pair[1]], 1_000_000):
            p = pair[1, lo:hi]
            size = t.item_from[p + 1] - t.item_from[p]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            found = np.unique(np.stack([np.repeat(pair[0, lo:hi], size), t.items[np.repeat(t.item_from[p], size) + place]]), axis=1)
            docs.append(found[0])
            items.append(found[1])
    found = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(found[0], minlength=batch.num_rows))), pa.int32()), pa.array(found[1], pa.int64()))
    hit = np.cumsum(step)[:-1] > 0
    spans, any_hit = spans_of(hit, w)
    out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w.count), spans, lists], names=["row", "doc_id", "n_words", "spans", "items"])
    return out if all_rows else out.filter(pa.array(any_hit))


def spans_of(hit: np.ndarray, w: Spaced) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of hit words in each document."""
    new = np.append(True, w.doc[1:] != w.doc[:-1])[: len(hit)]
    begin = np.flatnonzero(hit & (new | ~np.append(False, hit[:-1])[: len(hit)]))
    end = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True)[: len(hit)]) + 1
    doc = w.doc[begin]
    count = np.bincount(doc, minlength=len(w.count))
    spans = pa.StructArray.from_arrays([pa.array(begin - (w.last - w.count)[doc]), pa.array(end - begin)], fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), spans), count > 0


def contaminated(docs: DataFrame, items: DataFrame, width: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit words as start and length, from 0) and items (ids, ascending) of every document.

    A window is `width` consecutive words of an item, or all words of an item that has fewer; a document word that any occurrence of a
    window covers is hit. Words are runs of letters a-z (A-Z in lower case), digits and all characters beyond ASCII. A null or
    empty text has no words: such items are never found, such documents come back without hits. Items with the same item_id count
    as one, items without it hit words but aren't listed. Documents that repeat, or have no doc_id, are rows of their own; other
    columns are ignored. Without documents there are no rows, without items no hits.
    """
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    shards = max(1, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    pieces = staged(chunks(plain, width, shards))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards > 1:
        numbered = staged(numbered)  # rows keep their numbers from pass to pass
    found = None
    for shard in range(shards):
        own = pieces.where(F.col("shard") == shard).select("item_id", "m", "text").toArrow()  # one bounded shard
        tables = []
        for m in sorted(set(own.column("m").to_pylist())):
            part = own.filter(pc.equal(own.column("m"), m))
            tables.append(compiled(m, part.column("item_id").to_pylist(), part.column("text").to_pylist()))
        one = scanned(numbered, docs.sparkSession.sparkContext.broadcast(tables), all_rows=shard == 0)
        found = one if found is None else found.unionByName(one)
    if shards > 1:
        found = merged(found)
    return found.drop("row")


def merged(found: DataFrame) -> DataFrame:
    """The hits of a document from all shards (a list for each) as one."""
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Runs that overlap or touch become one: a run goes on as long as a span starts no later than the furthest end so far.
    step = "case when size(acc) > 0 and acc[size(acc) - 1].start + acc[size(acc) - 1].length >= x.start then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'length', greatest(acc[size(acc) - 1].length, x.start + x.length - acc[size(acc) - 1].start)))) else concat(acc, array(x)) end"
    joined = F.expr(f"aggregate(array_sort(spans), slice(spans, 1, 0), (acc, x) -> {step})")
    return rows.select("row", "doc_id", "n_words", joined.alias("spans"), "items")
