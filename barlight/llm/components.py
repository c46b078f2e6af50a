"""Connected components by small stars and pointer jumps on locally contracted edges.

All edges point from a larger id to a smaller one. Each task first replaces the edges it has by a forest of stars (a node and the
smallest id that its own edges reach), which keeps what is connected. While a node points to several others, it and they are
pointed to the smallest of them: one exchange by the larger end, where a node never has more edges than there were tasks. What is left is a
forest of single pointers, whose depth halves with every join on itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from barlight.session import staged

MOST_NODES = 500_000  # nodes a task keeps before it lets its stars go


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        root = i
        while (up := parent.get(root, root)) != root:
            root = up
        while i != root:
            parent[i], i = root, parent[i]
        return root

    def given() -> pa.RecordBatch:
        nodes = [i for i in parent if find(i) != i]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([parent[i] for i in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield given()
            parent.clear()
    yield given()


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every node of edges (a, b); nulls and loops are left out. Rounds are written."""

    def written(frame: DataFrame, moved: Column) -> tuple[DataFrame, int]:
        seen = Observation()
        out = staged(frame.observe(seen, F.count_if(moved).alias("moved")).mapInArrow(_stars, "u bigint, v bigint"))
        return out, seen.get["moved"]

    given = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    current, moved = written(given, F.lit(True))
    while moved:
        own = Window.partitionBy("u")
        rows = current.select("u", "v", F.min("v").over(own).alias("m"), F.row_number().over(own.orderBy("v")).alias("n"))
        # The first of a node's edges stays; the smaller ends of the others point to its end.
        following = rows.select(F.when(F.col("n") == 1, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), "n").filter("u <> v")
        current, moved = written(following, F.col("n") > 1)
    moved = True
    while moved:
        seen = Observation()
        jumped = current.alias("a").join(current.alias("b"), F.col("a.v") == F.col("b.u"), "left").select("a.u", F.coalesce("b.v", "a.v").alias("v"), F.col("b.v").isNotNull().alias("far"))
        current = staged(jumped.observe(seen, F.count_if("far").alias("moved")).drop("far"))
        moved = seen.get["moved"]
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
