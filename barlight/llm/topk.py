"""Exact nearest rows by inner product: columnar branch and bound.

Vectors are packed into blocks in vertical layout, one contiguous column for each dimension. A block of queries meets a
block of candidates; partial products are accumulated a few dimensions at a time. What the remaining dimensions
can add is at most the product of the remaining masses (Cauchy-Schwarz), so candidates whose best possible score is below
the k-th best certain score are dropped and the surviving ones compacted before the next dimensions are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.session import staged

BLOCK_ROWS = 4096
PACKED = pa.schema([("is_query", pa.bool_()), ("dim", pa.int32()), ("qb", pa.int64()), ("ids", pa.binary()), ("columns", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EXACT = 2.0**53  # integers a double holds exactly


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles: scaling by a power of two and rounding down are exact."""
    return np.floor(256.0 * values.astype(np.float64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS vectors of the same length; queries are packed a second time as queries."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("vector"))
        usable = pc.and_(pc.is_valid(vectors), pc.is_valid(batch.column(0)))
        batch = batch.filter(usable)
        vectors = batch.column(batch.schema.get_field_index("vector"))
        sizes = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
        flat = np.asarray(pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
        starts = np.cumsum(sizes) - sizes
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        asks = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            matrix = flat[starts[rows][:, None] + np.arange(dim)]
            whole = np.isfinite(matrix).all(axis=1)
            rows, matrix = rows[whole], scaled(matrix[whole])
            for is_query in (False, True):
                chosen = np.flatnonzero(asks[rows]) if is_query else np.arange(len(rows))
                for at in range(0, len(chosen), BLOCK_ROWS):
                    part = chosen[at : at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pylist([{"is_query": is_query, "dim": dim, "qb": None, "ids": ids[rows[part]].tobytes(), "columns": np.ascontiguousarray(matrix[part].T).tobytes()}], schema=PACKED)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: position of the query, candidate's id, score.

    queries and columns are vertical (dimension by row). Ties go to the smaller id; a row isn't its own candidate.
    """
    dim, n = columns.shape
    peak = np.abs(queries).max(initial=0.0) * np.abs(columns).max(initial=0.0) * dim
    if peak >= EXACT:  # products a double can't hold: the same scan with Python's integers, clipped to 64 bits
        return _best_wide(query_ids, queries, ids, columns, k)
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], columns[:, order]
    rest_x = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1])
    rest_q = np.sqrt(np.cumsum((queries**2)[::-1], axis=0)[::-1])
    first = min(step, dim)
    partial = queries[:first].T @ columns[:first]
    out_q, out_i, out_s = [], [], []
    for j in range(len(query_ids)):
        alive = np.flatnonzero(ids != query_ids[j])
        score, at = partial[j, alive], first
        while len(alive):
            if at < dim:
                room = rest_q[at, j] * rest_x[at, alive] * (1 + 1e-9) + 1.0
                if len(alive) > k:
                    sure = np.partition(score - room, len(alive) - k)[len(alive) - k]
                    keep = score + room >= sure
                    alive, score = alive[keep], score[keep]
                upto = min(dim, at + step)
                score = score + queries[at:upto, j] @ columns[at:upto, alive]
                at = upto
            else:
                top = np.lexsort((ids[alive], -score))[:k]
                out_q.append(np.full(len(top), j))
                out_i.append(ids[alive[top]])
                out_s.append(score[top].astype(np.int64))
                break
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (out_q, out_i, out_s))


def _best_wide(query_ids, queries, ids, columns, k):
    low, high = -(2**63), 2**63 - 1
    wide = [[int(v) for v in row] for row in columns.T.tolist()]
    out_q, out_i, out_s = [], [], []
    for j, query in enumerate(queries.T.tolist()):
        q = [int(v) for v in query]
        scores = ((-min(high, max(low, sum(a * b for a, b in zip(q, x, strict=True)))), int(i)) for i, x in zip(ids, wide, strict=True) if i != query_ids[j])
        for s, i in sorted(scores)[:k]:
            out_q.append(j)
            out_i.append(i)
            out_s.append(-s)
    return np.array(out_q, np.int64), np.array(out_i, np.int64), np.array(out_s, np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of every query row.

    Every row but the query's own id is a candidate. Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part; vectors meet only vectors of their own length. Rows that repeat an id compete as one row each,
    and a repeated query id gets one answer. Ties go to the smaller id, so results don't depend on partitioning. Scores
    beyond 64 bits are clipped.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"), F.col(vector_column).alias("vector"))
    packed = staged(rows.filter("id IS NOT NULL").mapInArrow(_pack, "is_query boolean, dim int, qb bigint, ids binary, columns binary"))
    queries = packed.filter("is_query").select("dim", "ids", "columns")
    # Query blocks are numbered: one row for each block of thousands of queries, so the list is short.
    numbered = staged(queries.withColumn("qb", F.monotonically_increasing_id()))
    blocks = numbered.groupBy("dim").agg(F.collect_list("qb").alias("qbs"))
    candidates = packed.filter("NOT is_query").join(blocks, "dim").select("ids", "columns", F.explode("qbs").alias("qb"))
    met = candidates.join(numbered.select("qb", "dim", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns")), "qb")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                columns = np.frombuffer(row["columns"], np.float64).reshape(row["dim"], -1)
                q_columns = np.frombuffer(row["q_columns"], np.float64).reshape(row["dim"], -1)
                for at in range(0, len(q_ids), 512):
                    part = slice(at, at + 512)
                    j, i, s = best(q_ids[part], q_columns[:, part], ids, columns, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][j], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], schema=FOUND)

    found = met.select("dim", "ids", "columns", "q_ids", "q_columns").mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
