"""Questions over saved results: scopes, rankings, pivots, distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions.scalar import display_label, ratio
from barlight.operators import backtest as bt
from barlight.operators.ordered import Blocks, running_peak
from barlight.operators.stress import PATH
from barlight.schema import CAPITAL

TIE_BREAKERS = ["expectancy", "sharpe", "bars"]
PRESETS = {"top_3": 3, "top_5": 5, "champion_plus_challengers": 5}


# --- scope -------------------------------------------------------------------


def in_dates(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """From start to the midnight after the end day, both included."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(column) <= F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df


def scoped_bars(price_regimes: DataFrame, start: str | None, end: str | None, regimes: Sequence[str] = ()) -> DataFrame:
    out = in_dates(price_regimes, start, end)
    return out.where(F.col("regime_name").isin(list(regimes))) if regimes else out


def _scope_dates(scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dates in scope, and the symbols that have any; a symbol without scope is not restricted."""
    dates = scope.select("symbol", "date").distinct()
    return dates, dates.select("symbol").distinct().withColumn("_scoped", F.lit(True))


def scoped_returns(returns: DataFrame, scope: DataFrame, strategies: Sequence[str] = ()) -> DataFrame:
    """Returns on the dates of the scope."""
    rows = returns.where(F.col("strategy").isin(list(strategies))) if strategies else returns
    dates, symbols = _scope_dates(scope)
    inside = rows.join(dates, ["symbol", "date"], "left_semi")
    return inside.unionByName(rows.join(symbols, "symbol", "left_anti"))


def scoped_trades(
    trades: DataFrame, scope: DataFrame, start: str | None, end: str | None, strategies: Sequence[str] = ()
) -> DataFrame:
    """Trades that touch the date range and enter or leave on a date of the scope."""
    rows = trades.where(F.col("strategy").isin(list(strategies))) if strategies else trades
    if start is not None:
        rows = rows.where(F.col("exit_date") >= F.lit(start).cast("timestamp_ntz"))
    rows = in_dates(rows, None, end, "entry_date")
    dates, symbols = _scope_dates(scope)
    entry = dates.select("symbol", F.col("date").alias("entry_date"), F.lit(True).alias("_in"))
    leave = dates.select("symbol", F.col("date").alias("exit_date"), F.lit(True).alias("_out"))
    rows = rows.join(entry, ["symbol", "entry_date"], "left").join(leave, ["symbol", "exit_date"], "left")
    rows = rows.join(symbols, "symbol", "left")
    keep = F.col("_scoped").isNull() | F.col("_in").isNotNull() | F.col("_out").isNotNull()
    return rows.where(keep).select(*trades.columns)


def scoped_metrics(returns: DataFrame, trades: DataFrame) -> DataFrame:
    """Metrics of the scoped returns and trades; without trades the win rate is that of the bars."""
    summary = bt.trade_summary(trades)
    out = bt.return_metrics(returns).join(summary, list(bt.KEYS), "left")
    out = out.withColumn("win_rate", F.coalesce("win_rate", "bar_win_rate"))
    return out.fillna(0, subset=["num_trades"]).fillna(0.0, subset=["profit_factor", "expected_r"])


def regime_lookup(price_regimes: DataFrame) -> DataFrame:
    """One label per date."""
    first = F.min_by(F.struct("regime_id", "regime_name"), "idx").alias("_l")
    return price_regimes.groupBy("symbol", "date").agg(first).select("symbol", "date", "_l.*")


def returns_by_regime(returns: DataFrame, price_regimes: DataFrame) -> DataFrame:
    return returns.join(regime_lookup(price_regimes), ["symbol", "date"]).where(F.col("regime_id").isNotNull())


def scoped_regime_metrics(returns: DataFrame, price_regimes: DataFrame) -> DataFrame:
    out = bt.return_metrics(returns_by_regime(returns, price_regimes), [*bt.KEYS, "regime_id", "regime_name"])
    return out.withColumn("win_rate", F.col("bar_win_rate"))


def scoped_paths(paths: DataFrame, strategies: Sequence[str] = (), filters: Sequence[str] = (), models: Sequence[str] = ()) -> DataFrame:
    for column, wanted in (("strategy", strategies), ("regime_filter", filters), ("stress_model", models)):
        if wanted:
            paths = paths.where(F.col(column).isin(list(wanted)))
    return paths


def focus(summary: DataFrame, strategy: str, regime: str, model: str) -> DataFrame:
    """The one summary row of a scenario, per symbol."""
    return summary.where(
        (F.col("strategy") == strategy) & (F.col("regime_filter") == regime) & (F.col("stress_model") == model)
    ).dropDuplicates(["symbol"])


# --- rankings ----------------------------------------------------------------


def ranking_order(columns: Sequence[str], metric: str, leading: Sequence[str] = ()) -> list[Column]:
    """Leading columns up, then the metric and the tie-breakers down; absent columns are skipped."""
    first = [c for c in dict.fromkeys(leading) if c in columns]
    then = [c for c in dict.fromkeys([metric, *TIE_BREAKERS]) if c in columns and c not in first]
    return [F.col(c).asc() for c in first] + [F.col(c).desc() for c in then]


def ranked(frame: DataFrame, metric: str, leading: Sequence[str] = (), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sort by symbol and ranking order and number the rows."""
    order = ranking_order(frame.columns, metric, leading)
    out = frame.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "strategy")))
    return out.orderBy(*keys, "position")


def preset(metrics: DataFrame, metric: str, mode: str) -> DataFrame:
    """The strategies a preset shows, best first."""
    rows = ranked(metrics, metric)
    return rows if mode == "all" else rows.where(F.col("position") <= PRESETS.get(mode, 5))


def regime_ranking(regime_metrics: DataFrame) -> DataFrame:
    """Bars and mean metrics per strategy and regime."""
    return regime_metrics.groupBy("symbol", "strategy", "regime_id", "regime_name").agg(
        F.sum("bars").alias("bars"),
        *[F.avg(c).alias(c) for c in ("total_return", "expectancy", "sharpe", "max_drawdown", "win_rate")],
    )


def best_regimes(regime_metrics: DataFrame, metric: str) -> DataFrame:
    """Each strategy's best regime by the ranking order."""
    order = ranking_order(regime_metrics.columns, metric)
    place = F.row_number().over(Window.partitionBy(*bt.KEYS).orderBy(*order, "regime_id"))
    best = regime_metrics.withColumn("_place", place).where(F.col("_place") == 1)
    return best.select(*bt.KEYS, "regime_name", F.col(metric).alias("score"))


def latest_trade(trades: DataFrame) -> DataFrame:
    """The trade that ended last, per symbol."""
    last = F.max_by(F.struct("*"), F.struct("exit_date", "entry_date", "strategy")).alias("_t")
    return trades.groupBy("symbol").agg(last).select("_t.*")


def leaderboard(variants: DataFrame, oos: DataFrame | None = None) -> DataFrame:
    """Out-of-sample ranking with labels and the recommended mark, else the variants by rank."""
    star = F.lit("★ Recommended - ")
    if oos is None:
        label = F.when(F.col("is_best"), F.concat(star, F.col("display_label"))).otherwise(F.col("display_label"))
        return variants.withColumn("label", label).orderBy("rank", F.col("rank_value").desc())
    rows = oos.withColumn("model_id", F.concat_ws("::", "candidate", "model_family"))
    names = variants.select("symbol", "model_id", "display_label", F.col("is_best").alias("recommended"))
    rows = rows.join(names, ["symbol", "model_id"], "left")
    rows = rows.withColumns(
        {
            "display_label": F.coalesce("display_label", display_label(F.col("model_id"))),
            "recommended": F.coalesce("recommended", F.lit(False)),
        }
    )
    label = F.when(F.col("recommended"), F.concat(star, F.col("display_label"))).otherwise(F.col("display_label"))
    return rows.withColumn("label", label).orderBy("symbol", "status", F.col("oos_score_mean").desc())


def augmented(metrics: DataFrame, trades: DataFrame) -> DataFrame:
    """Fill missing trade metrics from the trades; best Sharpe first."""
    names = ["num_trades", "win_rate", "profit_factor", "expected_r"]
    summary = bt.trade_summary(trades).select(*bt.KEYS, *[F.col(c).alias(f"_{c}") for c in names])
    out = metrics.join(summary, list(bt.KEYS), "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(c, f"_{c}") if c in metrics.columns else F.col(f"_{c}")).drop(f"_{c}")
    return out.orderBy(F.col("sharpe").desc())


# --- series and pivots -------------------------------------------------------


def signal_markers(price: DataFrame, signals: DataFrame, strategy: str) -> DataFrame:
    """Price at every bar with a long or short signal."""
    rows = price.select("symbol", "date", "close").join(
        signals.where(F.col("strategy") == strategy).select("symbol", "date", "signal"), ["symbol", "date"]
    )
    side = F.when(F.col("signal") > 0, "long").when(F.col("signal") < 0, "short")
    return rows.withColumn("marker", side).where(F.col("marker").isNotNull())


def drawdown_series(equity: DataFrame) -> DataFrame:
    rows = running_peak(equity, "equity", "_peak", Blocks.of(equity, *bt.KEYS))
    return rows.withColumn("drawdown", ratio(F.col("equity"), F.col("_peak")) - 1).drop("_peak")


def regime_pivot(regime_metrics: DataFrame, metric: str, regimes: Sequence[str]) -> DataFrame:
    """Strategies down, regimes across, mean of the metric."""
    return regime_metrics.groupBy(*bt.KEYS).pivot("regime_name", list(regimes)).agg(F.avg(metric))


def melted_shares(stability: DataFrame) -> DataFrame:
    """Shares of each regime as rows."""
    names = [c for c in stability.columns if c.startswith("regime_") and c.endswith("_share")]
    ids = [c for c in stability.columns if c not in names]
    long = stability.unpivot(ids, names, "regime", "share")
    return long.withColumn("regime", F.regexp_replace("regime", "regime_|_share", ""))


# --- path distributions ------------------------------------------------------


BANDS = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def path_bands(paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equity percentiles and mean per step; a step holds one row per simulation, a number set by the caller.

    Paths have a row for each step, or for each piece of steps, with an array of equity.
    """
    if isinstance(paths.schema["equity"].dataType, T.ArrayType):
        return _piece_bands(paths, by)
    out = paths.where(F.col("equity").isNotNull()).groupBy(*by, "step").agg(
        F.percentile("equity", F.array(*[F.lit(p) for p in BANDS.values()])).alias("_p"), F.avg("equity").alias("mean")
    )
    return out.select(*by, "step", *[F.col("_p")[i].alias(n) for i, n in enumerate(BANDS)], "mean")


def _piece_bands(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """A group is all simulations' pieces from one step on, sorted by step; between two values a percentile is linear."""
    by = list(by)

    def bands(key: tuple, rows: pa.Table) -> pa.Table:
        equity = rows["equity"].combine_chunks()
        values = np.sort(equity.flatten().to_numpy().reshape(len(equity), -1), axis=0)
        out = {c: pa.repeat(value, values.shape[1]) for c, value in zip(by, key)}
        out["step"] = pa.array(key[-1].as_py() + np.arange(values.shape[1]), pa.int32())
        for name, p in BANDS.items():
            place = p * (len(values) - 1)
            low, high = math.floor(place), math.ceil(place)
            out[name] = values[low] + (values[high] - values[low]) * (place - low)
        return pa.table(out | {"mean": [math.fsum(step) / len(step) for step in values.T.tolist()]})

    kinds = [T.StructField(c, pieces.schema[c].dataType) for c in by] + [T.StructField("step", T.IntegerType())]
    schema = T.StructType(kinds + [T.StructField(c, T.DoubleType()) for c in [*BANDS, "mean"]])
    return pieces.select(*by, "step", "equity").groupBy(*by, "step").applyInArrow(bands, schema)


def average_paths(paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median equity per step."""
    bands = path_bands(paths, by)
    return bands.select(*by, "step", F.col("mean").alias("average"), F.col("p50").alias("median"))


def terminal_frame(paths: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Last equity, its return, and the worst drawdown of every path."""
    so_far = Window.partitionBy(*PATH).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("_fall", ratio(F.col("equity"), F.max("equity").over(so_far)) - 1)
    out = rows.groupBy(*PATH).agg(F.max_by("equity", "step").alias("terminal_equity"), F.min("_fall").alias("max_drawdown"))
    return out.withColumn("terminal_return", F.col("terminal_equity") / capital - 1)


def ending_balances(terminal: DataFrame, by: Sequence[str]) -> DataFrame:
    x = F.col("terminal_equity")
    return terminal.groupBy(*by).agg(
        F.avg(x).alias("average_equity"), F.percentile(x, F.lit(0.5)).alias("median_equity"),
        F.min(x).alias("min_equity"), F.max(x).alias("max_equity"),
    )


def histogram(terminal: DataFrame, column: str, by: Sequence[str], bins: int = 40) -> DataFrame:
    """Counts in equal-width bins from the least to the largest value."""
    span = terminal.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.floor(ratio(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    rows = terminal.join(span, list(by)).withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("paths"), F.min("_lo").alias("low"), F.max("_hi").alias("high"))


def distribution_marks(terminal: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    marks = terminal.groupBy(*by).agg(
        F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_p")
    )
    return marks.select(*by, *[F.col("_p")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


def mean_loss_probability(summary: DataFrame) -> DataFrame:
    return summary.groupBy("symbol").agg(F.avg("probability_of_loss").alias("probability_of_loss"))


def scenario_table(summary: DataFrame) -> DataFrame:
    """Scenarios side by side, safest first."""
    return summary.select(
        "symbol", "strategy", "stress_model", "regime_filter", "simulations", "horizon", "terminal_equity_p50",
        "terminal_equity_p95", "max_drawdown_p95", "probability_of_loss", "risk_of_ruin",
    ).orderBy("probability_of_loss", "risk_of_ruin")


def first_paths(paths: DataFrame, count: int) -> DataFrame:
    return paths.where(F.col("simulation") < count)
