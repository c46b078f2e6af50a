"""Documents in compressed blocks that ask a hashed index questions in bulk.

Operators that compare every run of words or bytes of a corpus can't move a row for each run. Here a block is one row
that holds some megabytes of documents, compressed; a task works on one block at a time with numpy. What blocks have to tell
each other are sorted arrays of hashes, dealt out by the hash's leading bits: a message holds a block's distinct hashes for one
bucket, a bucket's task answers each message with a few bits for each hash, in the same order. A hash that a third of all
documents share is sent once by each block, so no bucket grows with the size of a group of copies.

Blocks are written once; tasks that are run again read the same blocks and make the same messages.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.common import slices, text_bytes
from barlight.session import staged

BLOCK = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary())])
MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
MESSAGE_SQL = "block bigint, bucket int, data binary"
BUCKET_BYTES = 16_000_000  # of text for each bucket of the index


def packed(docs: DataFrame, block_bytes: int, column: str = "text") -> DataFrame:
    """The rows of docs in blocks of about block_bytes of a string or binary column, staged; a longer value has a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            off, _ = text_bytes(batch.column(batch.schema.get_field_index(column)))
            for a, b in slices(np.diff(off) + 32, block_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(a, b - a).columns], schema=batch.schema))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([off[b] - off[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=BLOCK)
                number += 1
            release_memory()

    return staged(docs.mapInArrow(run, "block bigint, n_bytes bigint, body binary"))


def opened(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes))


def spread(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of the runs of sorted hashes that go to each bucket."""
    if not len(hashes):
        return []
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[edges].astype(int).tolist(), edges.tolist(), [*edges[1:].tolist(), len(hashes)], strict=True))


def squeezed(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length, byte planes apart (sorted ones should come as differences), compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueezed(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with the answers to each round of questions as one array for each."""
    for i, answer in enumerate(answers):
        # A block gets as many answers as it sent messages, of a few bits for each of its own hashes.
        own = answer.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(f"answers{i}"))
        blocks = blocks.join(own, "block", "left")
    return blocks


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, next to the executor's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def each_block(frame: DataFrame, work: Callable[[int, pa.RecordBatch, list[dict[int, bytes]]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run work(block, documents, answers of each round) on every block of with_answers()."""
    rounds = [c for c in frame.columns if c.startswith("answers")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from work(row["block"], opened(row["body"]), [{a["bucket"]: a["data"] for a in row[c] or []} for c in rounds])
            release_memory()

    return frame.select("block", "body", *rounds).mapInArrow(run, schema)


def asked(frame: DataFrame, ask: Callable, decide: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """One round of questions; ask yields MESSAGE batches, decide gets a bucket's messages and returns an answer for each."""

    def answer(messages: pa.Table) -> pa.Table:
        order = np.argsort(messages.column("block").to_numpy(), kind="stable")
        messages = messages.take(pa.array(order))
        answers = decide(messages.column("data").to_pylist())
        release_memory()
        return messages.set_column(2, "data", pa.array(answers, pa.binary()))

    return staged(each_block(frame, ask, MESSAGE_SQL).groupBy("bucket").applyInArrow(answer, MESSAGE_SQL))


def messages(block: int, found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=MESSAGE)


def hash_messages(block: int, hashes: np.ndarray, marks: np.ndarray, buckets: int, drop_bits: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted distinct hashes, each with a small mark. drop_bits: low bits left out, where a rare false meeting does no harm."""
    found = []
    for bucket, a, b in spread(hashes, buckets):
        found.append((bucket, squeezed(differences(hashes[a:b] >> np.uint64(drop_bits)), marks[a:b].astype(np.uint8))))
    return messages(block, found)


def met_elsewhere(data: list[bytes], hot: int = 4096) -> list[bytes]:
    """For each hash: 1 if another block sent it too or its mark was set, and 2 more if over `hot` blocks did."""
    parts = [unsqueezed(d, np.uint64, np.uint8) for d in data]
    hashes = np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in parts])
    _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
    met = (count[group] > 1) | (np.concatenate([m for _, m in parts]) > 0)
    answer = (met + 2 * (count[group] > hot)).astype(np.uint8)
    return split_answer(answer, [len(h) for h, _ in parts])


def split_answer(answer: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [zstandard.ZstdCompressor(level=1).compress(answer[e - n : e].tobytes()) for n, e in zip(sizes, ends.tolist(), strict=True)]


def gathered(answers: dict[int, bytes], size: int) -> np.ndarray:
    """The answers of a round in the order of the sorted hashes that were sent."""
    out = b"".join(zstandard.ZstdDecompressor().decompress(answers[b]) for b in sorted(answers))
    if len(out) != size:
        raise ValueError(f"{len(out)} answers to {size} questions")
    return np.frombuffer(out, np.uint8)
