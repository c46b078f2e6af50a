"""Regime models from feature tables: preparation, assignment, quadrant labels, scores.

Every function takes the key columns of a model (symbol, and where needed candidate,
family, block), so all models of a run are handled together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.scalar import finite
from barlight.operators.ordered import Blocks, row_chunk, with_ordinal
from barlight.schema import REGIME_NAMES, TINY
from barlight.session import sized, staged

AXES = ["vol_axis", "structure_axis"]
STATES = 4
LEAST_ROWS = max(120, 30 * STATES)


def regime_name(regime_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in REGIME_NAMES]), regime_id.cast("int") + 1)


# --- preparation -------------------------------------------------------------


def column_gate(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key and column: non-null count, population deviation, and whether a model may use it."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), F.stddev_pop(c).alias("deviation"))
        for c in columns
    ]
    table = features.groupBy(*keys).agg(F.array(*cells).alias("_cells")).select(*keys, F.inline("_cells"))
    deviation = F.coalesce("deviation", F.lit(0.0))
    return table.withColumn("usable", (F.col("non_null") >= 20) & (deviation > TINY))


def usable_columns(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per key: the names a model may use; the two axes are always among them."""
    gate = column_gate(features, columns, keys).where(F.col("usable") | F.col("column").isin(AXES))
    return gate.groupBy(*keys).agg(F.collect_set("column").alias("used"))


def complete_rows(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows on which all used columns are known, for keys with enough columns and rows.

    Adds ``used``, ``pos`` (the position among the kept rows) and ``feature_rows``. The
    feature table is written once, as the gate and the rows both read it.
    """
    features = staged(features.withColumns({c: finite(F.col(c)) for c in columns}))
    rows = features.join(sized(usable_columns(features, columns, keys)), list(keys)).where(F.size("used") >= 3)
    known = [F.col(c).isNotNull() | ~F.array_contains("used", c) for c in columns]
    for condition in known:
        rows = rows.where(condition)
    rows = with_ordinal(rows, keys, ("date", "idx"), out="pos", total="feature_rows")
    return rows.where(F.col("feature_rows") >= LEAST_ROWS)


def scaling(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean and population deviation of each column, as two arrays per key."""
    return rows.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in columns]).alias("center"),
        F.array(*[F.stddev_pop(c) for c in columns]).alias("spread"),
    )


def standardised(rows: DataFrame, columns: Sequence[str], scale: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``z``, the scaled columns; a column that is not used or constant is 0 everywhere."""
    out = rows.join(scale.select(*keys, "center", "spread"), list(keys))
    cells = []
    for i, c in enumerate(columns):
        live = F.array_contains("used", c) if "used" in rows.columns else F.lit(True)
        spread = F.col("spread")[i]
        cells.append(F.coalesce(F.when(live & (spread > TINY), (F.col(c) - F.col("center")[i]) / spread), F.lit(0.0)))
    return out.withColumn("z", F.array(*cells)).drop("center", "spread")


# --- assignment and labels ---------------------------------------------------


def squared_distances() -> Column:
    """Squared distance of the point ``z`` to each of the ``centers``."""
    return F.expr(
        "transform(centers, c -> aggregate(zip_with(z, c, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))"
    )


def nearest(distances: str) -> Column:
    """Number of the nearest center, the lowest on ties."""
    return F.expr(f"CAST(array_position({distances}, array_min({distances})) - 1 AS INT)")


def assigned(rows: DataFrame, centers: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``raw``, the nearest of the key's given centers."""
    out = rows.join(centers.select(*keys, "centers"), list(keys))
    out = out.withColumn("_d", squared_distances())
    return out.withColumn("raw", nearest("_d")).drop("centers", "_d")


def axis_stats(rows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars and mean axes per raw cluster."""
    return rows.groupBy(*keys, "raw").agg(
        F.count(F.lit(1)).alias("bars"), F.avg("vol_axis").alias("vol_axis"), F.avg("structure_axis").alias("structure_axis")
    )


def quadrants(stats: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Cluster to regime: the two calm clusters, then the two wild ones, each pair split by structure.

    Keys without exactly four clusters give no rows.
    """
    key = Window.partitionBy(*keys)
    ranked = stats.withColumns(
        {
            "_n": F.count(F.lit(1)).over(key),
            "_wild": F.row_number().over(key.orderBy("vol_axis", "structure_axis", "raw")) > 2,
        }
    ).where(F.col("_n") == STATES)
    trending = F.row_number().over(Window.partitionBy(*keys, "_wild").orderBy("structure_axis", "raw")) == 2
    ranked = ranked.withColumn("_trend", trending)
    regime = (
        F.when(~F.col("_wild") & ~F.col("_trend"), 0)
        .when(~F.col("_wild"), 1)
        .when(F.col("_trend"), 2)
        .otherwise(3)
    )
    return ranked.select(*keys, "raw", "bars", *AXES, regime.alias("regime_id")).withColumn(
        "regime_name", regime_name(F.col("regime_id"))
    )


def with_regimes(rows: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return rows.join(mapping.select(*keys, "raw", "regime_id", "regime_name"), [*keys, "raw"])


def label_table(
    labelled: DataFrame, model: str | Column, keys: Sequence[str] = ("symbol",), posteriors: Column | None = None
) -> DataFrame:
    """Names and probabilities: one-hot, or the four given posteriors by regime."""
    name = F.lit(model) if isinstance(model, str) else model
    probabilities = [
        (F.when(F.col("regime_id") == k, 1.0).otherwise(0.0) if posteriors is None else posteriors[k]).alias(
            f"prob_regime_{k}"
        )
        for k in range(STATES)
    ]
    return labelled.select(
        *keys, "idx", "date", "regime_id", regime_name(F.col("regime_id")).alias("regime_name"),
        name.alias("regime_model"), *probabilities,
    )


def folded_posteriors(state_probabilities: Column, state_regimes: Column) -> Column:
    """Posteriors by hidden state to posteriors by regime."""
    cells = []
    for k in range(STATES):
        parts = [F.when(state_regimes[s] == k, state_probabilities[s]).otherwise(0.0) for s in range(STATES)]
        cells.append(sum(parts[1:], parts[0]))
    return F.array(*cells)


# --- tables over labels ------------------------------------------------------


def regime_stats(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars and mean of every feature per regime."""
    out = labelled.groupBy(*keys, "regime_id").agg(
        F.count(F.lit(1)).alias("bars"), *[F.avg(c).alias(f"{c}_mean") for c in columns]
    )
    for alias, axis in (("rolling_vol_long_mean", "vol_axis_mean"), ("trend_strength_mean", "structure_axis_mean")):
        if alias not in out.columns:
            out = out.withColumn(alias, F.col(axis))
    return out.withColumn("regime_name", regime_name(F.col("regime_id")))


def with_previous(labelled: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Add the regime of the row before; null on the first row of a key."""
    b = Blocks(Blocks.of(labelled).rows, tuple(keys), order)
    rows = b.halo(labelled, back=1)
    return b.own(rows.withColumn("previous", F.lag("regime_id").over(b.order))).drop("_blk")


def transitions(labelled: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "idx") -> DataFrame:
    """Share of moves from each regime to each regime."""
    moves = with_previous(labelled, keys, order).where(F.col("previous").isNotNull())
    counts = moves.groupBy(*keys, F.col("previous").alias("from_regime")).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("regime_id") == k).alias(f"_{k}") for k in range(STATES)],
    )
    return counts.select(*keys, "from_regime", *[(F.col(f"_{k}") / F.col("_all")).alias(f"to_{k}") for k in range(STATES)])


def _shares() -> list[Column]:
    return [F.avg(F.when(F.col("regime_id") == k, 1.0).otherwise(0.0)).alias(f"regime_{k}_share") for k in range(STATES)]


def stability(labelled: DataFrame, window: int = 2_000, keys: Sequence[str] = ("symbol",), order: str = "pos") -> DataFrame:
    """Regime shares per run of ``window`` rows; the last run may be short."""
    rows = row_chunk(labelled, window, "_chunk", order)
    return rows.groupBy(*keys, "_chunk").agg(
        F.min("date").alias("window_start"), F.max("date").alias("window_end"), F.count(F.lit(1)).alias("bars"), *_shares()
    ).drop("_chunk")


def stability_score(labelled: DataFrame, window: int = 2_000, keys: Sequence[str] = ("symbol",), order: str = "pos") -> DataFrame:
    """1 - 4 x mean deviation of the shares over runs; 0.5 when there is too little to tell."""
    runs = stability(labelled, window, keys, order)
    full = F.col("bars") >= max(20, window // 4)
    deviations = [F.stddev_pop(F.when(full, F.col(f"regime_{k}_share"))) for k in range(STATES)]
    table = runs.groupBy(*keys).agg(
        F.sum("bars").alias("_rows"), F.count_if(full).alias("_runs"), (sum(deviations[1:], deviations[0]) / STATES).alias("_dev")
    )
    known = (F.col("_rows") >= max(window, 20)) & (F.col("_runs") >= 2)
    score = F.when(known, F.greatest(F.lit(0.0), 1.0 - 4.0 * F.col("_dev"))).otherwise(0.5)
    return table.select(*keys, score.alias("rolling_stability_score"))


# --- scores ------------------------------------------------------------------


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _mean_of(*columns: Column) -> Column:
    """Mean of the known ones among a few columns."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(known > 0, total / known)


def _population_deviation(columns: Sequence[Column]) -> Column:
    mean = _mean_of(*columns)
    return F.sqrt(_mean_of(*[(c - mean) * (c - mean) for c in columns]))


def balance_persistence(labelled: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Row count, smallest regime share, balance, persistence and churn.

    The first row has no row before it: it counts as neither kept nor unchanged.
    """
    rows = with_previous(labelled, keys, order)
    kept = F.coalesce(F.col("previous") == F.col("regime_id"), F.lit(False))
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(kept, 1.0).otherwise(0.0)).alias("transition_persistence"),
        F.avg(F.when(kept, 0.0).otherwise(1.0)).alias("churn"),
        *_shares(),
    )
    least = F.least(*[F.col(f"regime_{k}_share") for k in range(STATES)])
    return table.select(
        *keys, "rows", least.alias("min_share"), _unit(least / 0.10).alias("cluster_balance_score"),
        "transition_persistence", "churn",
    )


def interpretability(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far the regime means lie apart on both axes, in deviations of those means."""
    vol = [F.avg(F.when(F.col("regime_id") == k, F.col("vol_axis"))).alias(f"v{k}") for k in range(STATES)]
    structure = [F.avg(F.when(F.col("regime_id") == k, F.col("structure_axis"))).alias(f"s{k}") for k in range(STATES)]
    table = labelled.groupBy(*keys).agg(*vol, *structure)
    v = [F.col(f"v{k}") for k in range(STATES)]
    s = [F.col(f"s{k}") for k in range(STATES)]
    low, high = _mean_of(v[0], v[1]), _mean_of(v[2], v[3])
    ranging, trending = _mean_of(s[0], s[3]), _mean_of(s[1], s[2])
    apart = (high - low) / (_population_deviation(v) + TINY) + (trending - ranging) / (_population_deviation(s) + TINY)
    score = F.when(apart.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), apart)) / 2.0)
    semantics = 0.5 * F.when(high > low, 1.0).otherwise(0.0) + 0.5 * F.when(trending > ranging, 1.0).otherwise(0.0)
    # With a pair of regimes absent the distance is unknown; the clamp then gives its upper end.
    return table.select(*keys, F.coalesce(score, F.lit(1.0)).alias("interpretability_score"), semantics.alias("semantics"))


def silhouette(labelled: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean silhouette of all rows of a key under squared Euclidean distance; 0 with a single regime or fewer than four rows.

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and sum of squares, so
    no pair of rows is ever made and no row is left out.
    """
    keys = list(keys)
    rows = labelled.select(*keys, "regime_id", "z", F.expr("aggregate(z, 0D, (s, x) -> s + x * x)").alias("_q"))
    sums = rows.select(*keys, "regime_id", F.posexplode("z")).groupBy(*keys, "regime_id", "pos").agg(F.sum("col").alias("s"))
    sums = sums.groupBy(*keys, "regime_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, s))), x -> x.s)").alias("s"))
    sizes = rows.groupBy(*keys, "regime_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"))
    # One row for each key, with an entry for each of its regimes.
    clusters = staged(sizes.join(sums, [*keys, "regime_id"]).groupBy(*keys).agg(F.collect_list(F.struct("regime_id", "n", "q", "s")).alias("_c")))
    far = "greatest(c.n * _q + c.q - 2 * aggregate(zip_with(z, c.s, (a, b) -> a * b), 0D, (t, x) -> t + x), 0D)"
    rows = rows.join(clusters, keys)
    rows = rows.withColumn("_a", F.expr(f"aggregate(filter(_c, c -> c.regime_id = regime_id), CAST(NULL AS DOUBLE), (t, c) -> CASE WHEN c.n > 1 THEN {far} / (c.n - 1) END)"))
    rows = rows.withColumn("_b", F.expr(f"array_min(transform(filter(_c, c -> c.regime_id <> regime_id), c -> {far} / c.n))"))
    value = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 4, F.avg(value)).otherwise(0.0).alias("silhouette_score"))


def candidate_scores(labelled: DataFrame, keys: Sequence[str], window: int = 2_000, order: str = "pos") -> DataFrame:
    """All score parts of each model, with the production, the development and the block score."""
    parts = (
        balance_persistence(labelled, keys, order)
        .join(interpretability(labelled, keys), list(keys))
        .join(stability_score(labelled, window, keys, order), list(keys))
        .join(silhouette(labelled, keys), list(keys))
    )
    return with_scores(parts)


def with_scores(parts: DataFrame) -> DataFrame:
    """Weighted sums of the parts; weights are fixed values."""
    silhouette_, balance = F.col("silhouette_score"), F.col("cluster_balance_score")
    persistence, clear = F.col("transition_persistence"), F.col("interpretability_score")
    churn_score = F.greatest(F.lit(0.0), 1.0 - F.col("churn") * 5.0)
    coverage = _unit(F.col("min_share") / 0.05)
    out = parts.withColumns({"churn_score": churn_score, "coverage_score": coverage})
    out = out.withColumn("dev_score", silhouette_ * 0.45 + balance * 0.25 + persistence * 0.10 + clear * 0.20)
    out = out.withColumn(
        "oos_score",
        silhouette_ * 0.30 + clear * 0.20 + persistence * 0.10
        + F.col("churn_score") * 0.15 + F.col("coverage_score") * 0.15 + F.col("semantics") * 0.10,
    )
    if "rolling_stability_score" in parts.columns:
        stable = F.col("rolling_stability_score")
        out = out.withColumn(
            "score", silhouette_ * 0.35 + balance * 0.20 + stable * 0.15 + persistence * 0.10 + clear * 0.20
        )
    return out


def best_model(scores: DataFrame, by: str = "score", keys: Sequence[str] = ("symbol",), model: str = "candidate") -> DataFrame:
    """Rank the models of a key by score; ``is_best`` marks the first."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), model)
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


