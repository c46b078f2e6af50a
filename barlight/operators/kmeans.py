"""K-Means for many models at once: the model's key is one more grouping column.

All keys and all starts advance together, one Spark job per step. A step reads the
point table, joins the small table of centers, and sums per (key, start, cluster) before
the shuffle, so a key with most of the rows costs no single task more than the others.
Starts come from the data and from hashes of the bar ordinal, so the fit does not depend
on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barlight.operators.regimes import STATES, nearest, squared_distances
from barlight.session import staged


def _mean_vector(dims: int) -> Column:
    return F.expr("array(" + ", ".join(f"avg(z[{j}])" for j in range(dims)) + ")")


def _by_cluster(fallback: str) -> Column:
    """Array of the four vectors; ``_found`` holds struct(raw, mean) of the clusters that have rows."""
    return F.expr(
        f"transform(sequence(0, {STATES - 1}), k -> coalesce(get(filter(_found, m -> m.raw = k), 0).mean, {fallback}))"
    )


def quadrant_start(points: DataFrame, keys: Sequence[str], dims: int, axes: tuple[int, int]) -> DataFrame:
    """Start 0: mean of the points in each sign quadrant of the two axes; an empty one starts at its corner."""
    v, s = axes
    side = F.expr(f"CASE WHEN z[{v}] > 0 THEN 2 ELSE 0 END + CASE WHEN z[{s}] > 0 THEN 1 ELSE 0 END")
    means = points.groupBy(*keys, side.alias("raw")).agg(_mean_vector(dims).alias("mean"))
    found = means.groupBy(*keys).agg(F.collect_list(F.struct("raw", "mean")).alias("_found"))
    corner = (
        f"transform(sequence(0, {dims - 1}), j -> CASE WHEN j = {v} THEN IF(k >= 2, 1D, -1D) "
        f"WHEN j = {s} THEN IF(k % 2 = 1, 1D, -1D) ELSE 0D END)"
    )
    return found.select(*keys, F.lit(0).alias("start"), _by_cluster(corner).alias("centers"))


def hashed_starts(points: DataFrame, keys: Sequence[str], starts: int, seed: int) -> DataFrame:
    """Further starts: four points each, the ones with the smallest hash of seed, start and ordinal."""
    cells = []
    for n in range(1, starts):
        picks = [F.min_by("z", F.xxhash64(F.lit(seed), F.lit(n), F.lit(k), F.col("idx"))) for k in range(STATES)]
        cells.append(F.struct(F.lit(n).alias("start"), F.array(*picks).alias("centers")))
    table = points.groupBy(*keys).agg(F.array(*cells).alias("_cells"))
    return table.select(*keys, F.inline("_cells"))


def step(points: DataFrame, centers: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """One assignment and update of all keys and starts; a cluster without points keeps its center."""
    rows = points.select(*keys, "z").join(centers.select(*keys, "start", "centers"), list(keys))
    rows = rows.withColumn("_d", squared_distances())
    sums = rows.groupBy(*keys, "start", nearest("_d").alias("raw")).agg(
        _mean_vector(dims).alias("mean"), F.sum(F.array_min("_d")).alias("_cost")
    )
    found = sums.groupBy(*keys, "start").agg(
        F.collect_list(F.struct("raw", "mean")).alias("_found"), F.sum("_cost").alias("cost")
    )
    rows = found.join(centers.select(*keys, "start", F.col("centers").alias("_old")), [*keys, "start"])
    rows = rows.withColumn("centers", _by_cluster("_old[k]"))
    shift = F.expr(
        "aggregate(flatten(zip_with(centers, _old, (a, b) -> zip_with(a, b, (x, y) -> (x - y) * (x - y)))), 0D, (t, x) -> t + x)"
    )
    return rows.select(*keys, "start", "centers", "cost", shift.alias("shift"))


def fit(
    points: DataFrame,
    keys: Sequence[str],
    dims: int,
    axes: tuple[int, int],
    starts: int = 20,
    seed: int = 181,
    max_iter: int = 100,
    tolerance: float = 1e-4,
) -> DataFrame:
    """Best of several starts per key: ``centers`` and their ``inertia``.

    ``points`` holds the keys, ``idx`` and ``z``, and should be a written table: it is read
    once per step. The center table is written each step, which also cuts the lineage.
    """
    centers = quadrant_start(points, keys, dims, axes)
    if starts > 1:
        centers = centers.unionByName(hashed_starts(points, keys, starts, seed))
    centers = staged(centers)
    for _ in range(max_iter):
        seen = Observation()
        centers = staged(step(points, centers, keys, dims).observe(seen, F.max("shift").alias("shift")))
        moved = seen.get["shift"]
        if moved is None or moved <= tolerance:
            break
    best = F.min_by(F.struct("centers", "cost"), F.struct("cost", "start")).alias("_b")
    return centers.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.centers").alias("centers"), F.col("_b.cost").alias("inertia")
    )
