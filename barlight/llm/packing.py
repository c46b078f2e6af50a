"""Concatenate and cut: documents as one long token stream, cut into fixed windows.

First pass: every task tokenizes its documents, writes their ids with a running offset inside the task, once. The totals of the
tasks (one row each) are summed up to the place where each task's stream begins. Second pass: a document's place in the
stream is known by adding two numbers, so it is cut at the window boundaries on its own. Nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.llm.blocks import release_memory
from barlight.llm.common import slices, text_bytes
from barlight.session import staged

END_ID = 1
TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
# Fixed value: how this kind of tokenizer cuts a text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 1_000_000  # of texts or ids worked on together


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: the white space of `\s` in such patterns (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(f"[{SPACE}]{{1000,}}")


class ByteLevelIds:
    """Little-endian 32-bit ids of texts under a byte-level tokenizer file of the GPT-2 kind, as the tokenizers library gives them
    without special tokens put around a text.

    The vocabulary comes from that file; in this kind of file a merge's place is its id, so tiktoken's merging, which is some
    four times as fast, gives the same ids. The file's added tokens are found in texts as they stand. A run of white space is one
    piece, but for its last character if more text follows; long runs are cut off here, since the pattern needs stack for each of their characters.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.added = {content: array("I", [i]).tobytes() for content, i in added.items()}
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.encoding = tiktoken.Encoding("bytes", pat_str=PIECE, mergeable_ranks=vocabulary_bytes(tokenizer), special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.split is None or self.split.search(text) is None:
            return self.plain(text)
        return b"".join(self.added[part] if k % 2 else self.plain(part) for k, part in enumerate(self.split.split(text)))

    def plain(self, text: str) -> bytes:
        out, at = [], 0
        for found in LONG_SPACE.finditer(text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            out += [self.pieces(text[at : found.start()]), array("I", self.encoding._encode_single_piece(text[found.start() : end])).tobytes()]
            at = end
        return b"".join([*out, self.pieces(text[at:])]) if out else self.pieces(text)

    def pieces(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteLevelIds:
    """One vocabulary for each worker, not for each task."""
    return ByteLevelIds(path)


def vocabulary_bytes(tokenizer) -> dict[bytes, int]:
    """Token bytes and ids. In the file each byte is written as a printable character: itself, or the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(back[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, begin (tokens before it in its part), n_tokens and ids of every document, with the end id."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, begin = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo, hi in slices(np.diff(text_bytes(whole.column(1))[0]), SLICE_BYTES):
                batch = whole.slice(lo, hi - lo)
                ids = [encode(t or "") + end for t in batch.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                begins = begin + np.cumsum(sizes) - sizes
                begin += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(begins), pa.array(sizes), pa.array(ids, pa.binary())], schema=TOKENS)
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, part int, begin bigint, n_tokens bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = 2048) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens; only the last sequence can be shorter.

    doc_id, start (the document's ids before the piece), length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset. A
    piece that does not start at 0 or does not reach doc_tokens is a boundary record: its document goes on in the
    neighbouring sequence. A null or empty text has only the end id. Repeated rows, and rows without doc_id, are packed
    each on their own; columns other than doc_id and text are ignored. No documents, no pieces.
    """
    tokens = staged(tokenized(docs, path or tokenizer_path()))
    # One row for each task of the first pass, whatever the number of documents.
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(4 * whole.column(2).to_numpy(), SLICE_BYTES):
                batch = whole.slice(lo, hi - lo)
                place, n = (batch.column(i).to_numpy() for i in (1, 2))
                ids = batch.column(3)
                count = (place + n - 1) // length - place // length + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                sequence = place[row] // length + k
                begin = np.maximum(place[row], sequence * length)
                stop = np.minimum(place[row] + n[row], (sequence + 1) * length)
                start = begin - place[row]
                raw = [memoryview(x.as_buffer()) for x in ids]
                pieces = [bytes(raw[r][4 * a : 4 * b]) for r, a, b in zip(row.tolist(), start.tolist(), (stop - place[row]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array(pieces, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)], schema=PIECES)
            release_memory()

    return placed.select("doc_id", (F.col("before") + F.col("begin")).alias("place"), "n_tokens", "ids").mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
