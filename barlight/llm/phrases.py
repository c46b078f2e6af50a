"""Repeated-phrase automata: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and found.

A window of `width` words is a passage that counts. Its anchor is the least hash of its `gram`-word phrases, so equal windows have
equal anchors. Round one finds anchors that recur anywhere; round two confirms windows with a recurring anchor by their
own hash. Each block of documents then has its shard of the automaton, compiled from the anchor phrases of just those
confirmed passages that it holds, so shards are bounded by the block; all its documents are streamed through, and wherever a phrase is found
the passages around it are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm import blocks as B
from barlight.llm.common import Words, mixed, rolled, sliding_min, text_bytes

BLOCK_BYTES = 2_000_000
PLACE_BITS = 26  # words of one block; its texts are far shorter
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept string"


class Windows:
    """The windows of a block's texts: their anchors and hashes."""

    def __init__(self, texts: pa.Array, width: int, gram: int):
        self.words = Words(*text_bytes(texts))
        n = len(self.words.start)
        if n >> PLACE_BITS:
            raise ValueError("a block has too many words")
        h = self.words.hashes()
        self.width, self.gram = width, gram
        grams = mixed(rolled(h, gram))
        place = np.uint64((1 << PLACE_BITS) - 1)
        keys = (grams & ~place) | np.arange(n, dtype=np.uint64)
        self.starts = np.flatnonzero(self.words.whole(width))
        anchor = (sliding_min(keys, width - gram + 1) & place)[self.starts].astype(np.int64)
        self.hashes = mixed(rolled(h, width))
        self.places, self.of_start = np.unique(anchor, return_inverse=True)
        self.anchors, self.of_place, count = np.unique(mixed(grams[self.places] ^ np.uint64(0x5851F42D4C957F2D)), return_inverse=True, return_counts=True)
        self.repeated = count > 1

    def candidates(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows whose anchor recurs; their distinct hashes, to which hash each belongs, which ones repeat here."""
        starts = self.starts[(met[self.of_place][self.of_start] & 1).astype(bool)]
        distinct, owner, count = np.unique(self.hashes[starts], return_inverse=True, return_counts=True)
        return starts, distinct, owner, count > 1

    def located(self, confirmed: np.ndarray) -> np.ndarray:
        """Starts of all occurrences of confirmed windows, found with the block's automaton.

        confirmed: starts of windows that are known to recur; one for each distinct passage would do.
        """
        if not len(confirmed):
            return confirmed
        text, begin = self.joined()
        end = begin + (self.words.end - self.words.start)
        phrases = np.unique(self.places[self.of_start[np.searchsorted(self.starts, confirmed)]])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in phrases.tolist():
            phrase = text[begin[p] : end[p + self.gram - 1]]
            automaton.add_word(phrase, len(phrase))
        automaton.make_automaton()
        hits = np.fromiter((x for pair in automaton.iter(text) for x in pair), np.int64)
        ends, sizes = hits[::2] + 1, hits[1::2]
        first = np.searchsorted(begin, ends - sizes)
        # A hit counts where it covers whole words.
        fits = (first < len(begin)) & (first + self.gram <= len(begin))
        first, ends, sizes = first[fits], ends[fits], sizes[fits]
        first = np.unique(first[(begin[first] == ends - sizes) & (end[first + self.gram - 1] == ends)])
        near = np.unique((first[:, None] - np.arange(self.width - self.gram + 1)).ravel())
        near = near[near >= 0]
        near = near[self.words.whole(self.width)[near]]
        return near[np.isin(self.hashes[near], np.unique(self.hashes[confirmed]))]

    def joined(self) -> tuple[str, np.ndarray]:
        """All words as one string of one character for each byte, and where each begins; a line end stands between documents."""
        w = self.words
        size = w.end - w.start
        begin = np.cumsum(size + 1) - size
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        new = np.append(True, w.doc[1:] != w.doc[:-1])
        out[begin[new] - 1] = 10
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + place] = w.raw[w.inside]
        return out.tobytes().decode("latin-1"), begin

    def removed(self, starts: np.ndarray) -> np.ndarray:
        n = len(self.words.start)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.width, -1)
        return np.cumsum(step)[:n] > 0

    def kept(self, removed: np.ndarray) -> pa.Array:
        """The words that stay, joined by one space, of each text."""
        w = self.words
        stays = ~removed
        size, doc = (w.end - w.start)[stays], w.doc[stays]
        lead = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
        total = size + lead
        out = np.full(int(total.sum()), 32, np.uint8)
        begin = np.cumsum(total) - size
        keep_bytes = np.repeat(stays, w.end - w.start)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + place] = w.raw[w.inside][keep_bytes]
        ends = np.append(0, np.cumsum(np.bincount(doc, weights=total, minlength=len(w.count)))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(w.count), pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def runs(mask: np.ndarray, owner: np.ndarray, docs: int, first_of: np.ndarray) -> pa.Array:
    """Maximal true runs of the mask within each owner, as lists of start and length."""
    before = np.append(False, mask[:-1] & (owner[1:] == owner[:-1])) if len(mask) else mask
    after = np.append(mask[1:] & (owner[1:] == owner[:-1]), False) if len(mask) else mask
    begin, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    doc = owner[begin]
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=docs)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first_of[doc]), pa.array(end - begin)], names=["start", "length"]))


def without_repeated_phrases(docs: DataFrame, width: int = 35, gram: int = 8) -> DataFrame:
    """Every text without the words that a recurring window covers.

    A window is `width` words in a row of one document; it recurs if its words also start anywhere else, in the same document
    or another, whatever copies there are: nothing of a passage that occurs twice stays. Windows are those of the input. Words are runs of
    other characters than space and the controls 9 to 13. A null or empty text has no words and comes back empty;
    rows that repeat, or have no doc_id, are documents of their own; other columns are ignored. spans are the removed runs, in words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = B.packed(rows, BLOCK_BYTES)
    buckets = B.bucket_count(blocks)

    def ask_anchors(block, batch, _) -> Iterator[pa.RecordBatch]:
        w = Windows(batch.column("text"), width, gram)
        return B.hash_messages(block, w.anchors, w.repeated, buckets, drop_bits=8)

    def ask_windows(block, batch, answers) -> Iterator[pa.RecordBatch]:
        w = Windows(batch.column("text"), width, gram)
        _, distinct, _, repeated = w.candidates(B.gathered(answers[0], len(w.anchors)))
        return B.hash_messages(block, distinct, repeated, buckets)

    anchors = B.asked(blocks, ask_anchors, B.met_elsewhere)
    windows = B.asked(B.with_answers(blocks, anchors), ask_windows, B.met_elsewhere)

    def cut(block, batch, answers) -> Iterator[pa.RecordBatch]:
        w = Windows(batch.column("text"), width, gram)
        starts, distinct, owner, _ = w.candidates(B.gathered(answers[0], len(w.anchors)))
        confirmed = starts[(B.gathered(answers[1], len(distinct))[owner] & 1).astype(bool)]
        removed = w.removed(w.located(confirmed))
        docs_here, doc = batch.num_rows, w.words.doc
        n_removed = np.bincount(doc[removed], minlength=docs_here).astype(np.int64)
        spans = runs(removed, doc, docs_here, w.words.last - w.words.count)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.words.count), pa.array(n_removed), spans, w.kept(removed)], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return B.each_block(B.with_answers(blocks, anchors, windows), cut, RESULT)
