"""Walk-forward evaluation: train/test blocks as one more key, no loop over blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.operators import backtest as bt
from barlight.operators import regimes as rg
from barlight.operators.ordered import Blocks, forward_fill, with_ordinal
from barlight.schema import CAPITAL, COST_BPS
from barlight.session import staged

BLOCK_KEYS = ("symbol", "strategy", "block")


@dataclass(frozen=True)
class WalkForward:
    train: int = 120_000
    test: int = 20_000
    step: int | None = None
    least_train: int = 50_000

    @property
    def stride(self) -> int:
        return int(self.step or self.test)

    @property
    def least_test(self) -> int:
        return max(200, 50 * rg.STATES)


def bar_counts(bars: DataFrame) -> DataFrame:
    """Number of bars per symbol."""
    return bars.groupBy("symbol").agg((F.max("idx") + 1).alias("n"))


def slices(counts: DataFrame, plan: WalkForward) -> DataFrame:
    """Train and test ranges [start, end) of every block; only whole test windows count."""
    last = F.col("n") - plan.train - plan.test
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(plan.stride).cast("long")))
    rows = counts.select("symbol", F.posexplode(starts).alias("block", "train_start"))
    end = F.col("train_start") + plan.train
    return rows.select(
        "symbol", "block", "train_start", end.alias("train_end"), end.alias("test_start"), (end + plan.test).alias("test_end")
    )


def in_blocks(rows: DataFrame, counts: DataFrame, plan: WalkForward, side: str) -> DataFrame:
    """Copy each row into every block whose train (or test) range holds its bar.

    Ranges are evenly spaced, so the block numbers follow from the bar's ordinal by
    arithmetic; the only join is with the one-row-per-symbol bar count.
    """
    offset, length = (0, plan.train) if side == "train" else (plan.train, plan.test)
    here = F.col("idx") - offset
    blocks = F.floor((F.col("n") - plan.train - plan.test) / plan.stride)
    first = F.greatest(F.ceil((here - length + 1) / plan.stride), F.lit(0).cast("long"))
    last = F.least(F.floor(here / plan.stride), blocks)
    inside = F.when(last >= first, F.sequence(first, last))
    return rows.join(counts, "symbol").withColumn("block", F.explode(inside.cast("array<int>"))).drop("n")


def valid_blocks(train: DataFrame, test: DataFrame, plan: WalkForward, keys: Sequence[str]) -> DataFrame:
    """Blocks with enough train and test rows."""
    a = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_rows")).where(F.col("train_rows") >= plan.least_train)
    b = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("test_rows")).where(F.col("test_rows") >= plan.least_test)
    return a.join(b, list(keys))


def scaled_sides(
    features: DataFrame, columns: Sequence[str], counts: DataFrame, plan: WalkForward, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and test rows of the valid blocks, both scaled by the train rows, and the row counts."""
    train = in_blocks(features, counts, plan, "train")
    test = in_blocks(features, counts, plan, "test")
    valid = staged(valid_blocks(train, test, plan, keys))
    wanted = valid.select(*keys)
    train, test = train.join(wanted, list(keys)), test.join(wanted, list(keys))
    scale = staged(rg.scaling(train, columns, keys))
    return staged(rg.standardised(train, columns, scale, keys)), staged(rg.standardised(test, columns, scale, keys)), valid


def labels_from_centers(train: DataFrame, test: DataFrame, centers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label test rows with given centers; clusters get their quadrant from the train rows."""
    mapping = staged(rg.quadrants(rg.axis_stats(rg.assigned(train, centers, keys), keys), keys))
    return rg.with_regimes(rg.assigned(test, centers, keys), mapping, keys)


def with_ranges(labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add the block's first and last train and test bars."""
    names = ranges.select(
        "symbol", "block",
        F.col("train_start").alias("train_start_idx"), (F.col("train_end") - 1).alias("train_end_idx"),
        F.col("test_start").alias("test_start_idx"), (F.col("test_end") - 1).alias("test_end_idx"),
    )
    return labels.join(names, ["symbol", "block"])


def block_scores(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Out-of-sample score of each block of each model."""
    parts = (
        rg.balance_persistence(labelled, keys, "idx")
        .join(rg.interpretability(labelled, keys), list(keys))
        .join(rg.silhouette(labelled, keys), list(keys))
    )
    return rg.with_scores(parts)


SCORE_PARTS = {
    "oos_silhouette": "silhouette_score",
    "oos_interpretability": "interpretability_score",
    "oos_persistence": "transition_persistence",
    "oos_churn": "churn",
    "oos_churn_score": "churn_score",
    "oos_min_share": "min_share",
    "oos_coverage_score": "coverage_score",
    "oos_semantics_score": "semantics",
}


def rank_models(
    scores: DataFrame, models: DataFrame, model_keys: Sequence[str], valid: DataFrame | None = None, usable: DataFrame | None = None
) -> DataFrame:
    """Mean and spread of the block scores per model, working models first, best score first.

    ``models`` lists every model tried: those without a scored block appear as failed, those whose candidate is not among
    ``usable`` (symbol, candidate) as skipped. ``valid`` lists the blocks (symbol, candidate, block) with enough rows; without
    it the scored ones count as all.
    """
    table = scores.groupBy(*model_keys).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.avg("oos_score").alias("oos_score_mean"),
        F.stddev_pop("oos_score").alias("oos_score_std"),
        *[F.avg(c).alias(n) for n, c in SCORE_PARTS.items()],
    )
    out = models.join(table, list(model_keys), "left").withColumnRenamed("blocks", "_scored")
    on = ["symbol", "candidate"]
    if valid is None:
        out = out.withColumn("blocks", F.col("_scored"))
    else:
        out = out.join(valid.groupBy(*on).agg(F.count_distinct("block").alias("blocks")), on, "left")
    out = out.withColumn("failed_blocks", F.col("blocks") - F.coalesce("_scored", F.lit(0)))
    known = F.lit(True)
    if usable is not None:
        out, known = out.join(usable.select(*on).distinct().withColumn("_usable", F.lit(True)), on, "left"), F.coalesce("_usable", F.lit(False))
    ok = F.col("_scored").isNotNull()
    out = out.withColumn("status", F.when(ok, "ok").when(known, "failed").otherwise("skipped"))
    reason = F.when(ok, None).when(known, "no block with enough rows could be scored").otherwise("too few complete rows or columns")
    out = out.withColumn("reason", reason).drop("_scored", "_usable")
    return out.orderBy("symbol", (F.col("status") == "ok").desc(), F.col("oos_score_mean").desc())


# --- strategies per block ----------------------------------------------------


def block_signals(signals: DataFrame, counts: DataFrame, plan: WalkForward, side: str = "test") -> DataFrame:
    return in_blocks(signals, counts, plan, side)


def block_regimes(bars: DataFrame, labels: DataFrame, counts: DataFrame, plan: WalkForward, side: str = "test") -> DataFrame:
    """Bars of each block with the block's own labels, filled forward inside the block."""
    rows = in_blocks(bars.select("symbol", "idx", "date"), counts, plan, side)
    named = labels.select("symbol", "block", "idx", "regime_id", "regime_name")
    rows = rows.join(labels.select("symbol", "block").distinct(), ["symbol", "block"])
    rows = rows.join(named, ["symbol", "block", "idx"], "left")
    return forward_fill(rows, ["regime_id", "regime_name"], Blocks.of(rows, "symbol", "block"))


def allowed_regimes(train_metrics: DataFrame, metric: str = "sharpe", threshold: float = 0.0) -> DataFrame:
    """Per block and strategy: the regimes whose train metric beats the threshold."""
    good = F.when(F.col(metric) > threshold, F.col("regime_id").cast("int"))
    out = train_metrics.groupBy(*BLOCK_KEYS).agg(F.sort_array(F.collect_set(good)).alias("allowed"))
    return out.select(
        *BLOCK_KEYS, "allowed", F.array_join(F.col("allowed").cast("array<string>"), ",").alias("allowed_regimes"),
        F.lit(metric).alias("filter_metric"), F.lit(float(threshold)).alias("filter_threshold"),
    )


def filtered_signals(signals: DataFrame, regimes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Zero the signal of bars whose regime is not allowed; blocks without a filter stay."""
    named = regimes.select("symbol", "block", "idx", "regime_id")
    rows = signals.join(named, ["symbol", "block", "idx"], "left")
    rows = rows.join(allowed.select(*BLOCK_KEYS, "allowed"), list(BLOCK_KEYS), "left")
    keep = F.col("allowed").isNull() | F.coalesce(
        F.array_contains("allowed", F.col("regime_id").cast("int")), F.lit(False)
    )
    return rows.withColumn("signal", F.when(keep, F.col("signal")).otherwise(0.0)).drop("regime_id", "allowed")


def rank_strategies(block_metrics: DataFrame) -> DataFrame:
    """Per strategy and regime over all blocks: number of blocks, mean metrics, bars."""
    table = block_metrics.groupBy("symbol", "strategy", "regime_id", "regime_name").agg(
        F.count_distinct("block").alias("blocks"),
        *[F.avg(c).alias(c) for c in ("sharpe", "expectancy", "max_drawdown", "win_rate")],
        F.sum("bars").alias("bars"),
    )
    best_first: list[Column] = [F.col(c).desc() for c in ("expectancy", "sharpe", "bars")]
    return table.orderBy("symbol", "regime_id", *best_first)


def stitched(returns: DataFrame) -> DataFrame:
    """Block returns one after the other; overlapping test bars are kept, in block order."""
    return with_ordinal(returns.drop("idx"), ("symbol", "strategy"), ("date", "block"))


def first_labels(labels: DataFrame) -> DataFrame:
    """One label per date, from the earliest block."""
    first = F.min_by(F.struct("regime_id", "regime_name"), "block").alias("_l")
    return labels.groupBy("symbol", "date").agg(first).select("symbol", "date", "_l.*")


@dataclass
class WalkForwardResult:
    signals: DataFrame
    returns: DataFrame
    equity: DataFrame
    metrics: DataFrame
    regime_metrics: DataFrame
    trades: DataFrame
    block_metrics: DataFrame
    block_regime_metrics: DataFrame
    ranking: DataFrame
    filters: DataFrame | None
    unfiltered: DataFrame | None


def evaluate(
    bars: DataFrame,
    signals: DataFrame,
    labels: DataFrame,
    plan: WalkForward,
    train_labels: DataFrame | None = None,
    filter_metric: str = "sharpe",
    filter_threshold: float = 0.0,
    capital: float = CAPITAL,
    cost_bps: float = COST_BPS,
    filter_rows: int = 5_000,
) -> WalkForwardResult:
    """Backtest every block's test slice with its own labels and stitch the blocks.

    With ``train_labels`` (labels of train rows by the block's own model) signals are first
    limited to the regimes that paid on the train slice, in blocks with at least
    ``filter_rows`` train rows; ``unfiltered`` lists the blocks left out.
    """
    counts = staged(bar_counts(bars))
    blocks = labels.select("symbol", "block").distinct()
    test = block_signals(signals, counts, plan).join(blocks, ["symbol", "block"])
    regimes = staged(block_regimes(bars, labels, counts, plan))
    filters = unfiltered = None
    if train_labels is not None:
        sizes = staged(train_labels.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("train_rows")))
        eligible = sizes.where(F.col("train_rows") >= filter_rows).select("symbol", "block")
        unfiltered = blocks.join(eligible, ["symbol", "block"], "left_anti").join(sizes, ["symbol", "block"], "left")
        train = block_signals(signals, counts, plan, "train").join(eligible, ["symbol", "block"])
        train_regimes = block_regimes(bars, train_labels.join(eligible, ["symbol", "block"]), counts, plan, "train")
        train_returns = staged(bt.strategy_returns(bars, train, cost_bps, BLOCK_KEYS))
        by_regime = bt.regime_metrics(train_returns, train_regimes, BLOCK_KEYS)
        filters = staged(allowed_regimes(by_regime, filter_metric, filter_threshold))
        test = filtered_signals(test, regimes, filters)
    test = staged(test)
    run = bt.run_backtests(bars, test, regimes, capital, cost_bps, BLOCK_KEYS)
    whole = staged(stitched(run.returns))
    trade_rows = staged(run.trades)
    by_date = whole.join(first_labels(labels), ["symbol", "date"])
    by_regime = bt.return_metrics(by_date, ["symbol", "strategy", "regime_id", "regime_name"])
    return WalkForwardResult(
        signals=test,
        returns=whole,
        equity=bt.equity_curves(whole, capital),
        metrics=bt.with_trade_metrics(bt.return_metrics(whole), bt.trade_summary(trade_rows)),
        regime_metrics=by_regime.withColumn("win_rate", F.col("bar_win_rate")),
        trades=trade_rows,
        block_metrics=run.metrics,
        block_regime_metrics=run.regime_metrics,
        ranking=rank_strategies(run.regime_metrics),
        filters=filters,
        unfiltered=unfiltered,
    )
