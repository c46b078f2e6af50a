"""Next-bar backtests over long signals, with metrics, trades and per-regime results.

Everything is keyed by symbol and strategy (plus whatever keys the caller adds, such as
a walk-forward block) and works on (key, block of bars) groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.scalar import ratio
from barlight.operators.ordered import Blocks, running_product
from barlight.operators.quantiles import distribution
from barlight.schema import BARS_PER_YEAR, CAPITAL, COST_BPS, TINY
from barlight.session import staged

KEYS = ("symbol", "strategy")
METRICS = [
    "bars", "total_return", "expectancy", "sharpe", "sortino", "max_drawdown", "var_95", "cvar_95", "bar_win_rate",
]
TRADE_METRICS = ["num_trades", "win_rate", "profit_factor", "expected_r"]


def strategy_returns(
    bars: DataFrame, signals: DataFrame, cost_bps: float = COST_BPS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Position = the signal one bar earlier; return = position x close change - cost of its change.

    Signals that carry ``close`` need no join; others get it from ``bars`` by the shared
    keys and ``idx``.
    """
    rows = signals
    if "close" not in rows.columns:
        shared = [k for k in keys if k in bars.columns]
        rows = rows.join(bars.select(*shared, "idx", "close"), [*shared, "idx"])
    rows = rows.select(*keys, "idx", "date", "signal", "close")
    b = Blocks.of(rows, *keys)
    rows = b.halo(rows, back=2)
    limited = F.least(F.greatest(F.coalesce("signal", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    rows = rows.withColumn("position", F.coalesce(F.lag(limited).over(b.order), F.lit(0.0)))
    turnover = F.abs(F.col("position") - F.coalesce(F.lag("position").over(b.order), F.lit(0.0)))
    moved = F.coalesce(ratio(F.col("close"), F.lag("close").over(b.order)) - 1, F.lit(0.0))
    rows = rows.withColumns({"turnover": turnover, "_move": moved})
    net = F.col("position") * F.col("_move") - F.col("turnover") * (cost_bps / 10_000.0)
    return b.own(rows).select(*keys, "idx", "date", "close", "position", "turnover", net.alias("return"))


def equity_curves(returns: DataFrame, capital: float = CAPITAL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compounded equity per bar."""
    b = Blocks.of(returns, *keys)
    rows = running_product(returns, 1 + F.coalesce("return", F.lit(0.0)), "_growth", b)
    return rows.withColumn("equity", capital * F.col("_growth")).select(*keys, "idx", "date", "equity", "return")


def drawdowns(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total growth, growth of the first bar, and worst drawdown of the compounded curve.

    A block is summed up by its growth, highest and lowest point, and worst fall; the
    worst fall of the whole curve follows from the table of blocks alone, because
    e / max(C, m) = min(e / C, e / m) for a peak C carried in from earlier blocks.
    """
    b = Blocks.of(returns, *keys)
    rows = b.mark(returns).withColumn("_e", F.product(1 + F.col("return")).over(b.prefix))
    rows = rows.withColumn("_fall", ratio(F.col("_e"), F.max("_e").over(b.prefix)))
    table = rows.groupBy(*keys, "_blk").agg(
        F.product(1 + F.col("return")).alias("_growth"),
        F.max("_e").alias("_high"),
        F.min("_e").alias("_low"),
        F.min("_fall").alias("_worst"),
        F.min_by("return", b.idx).alias("_first"),
    )
    table = table.withColumn("_before", F.coalesce(F.product("_growth").over(b.earlier_blocks), F.lit(1.0)))
    table = table.withColumn("_peak", F.max(F.col("_before") * F.col("_high")).over(b.earlier_blocks))
    from_carry = ratio(F.col("_before") * F.col("_low"), F.col("_peak"))
    return table.groupBy(*keys).agg(
        F.product("_growth").alias("growth"),
        (1 + F.min_by("_first", "_blk")).alias("first_growth"),
        (F.min(F.least(F.col("_worst"), from_carry)) - 1).alias("max_drawdown"),
    )


def _scaled(mean: Column, deviation: Column, bars_per_year: float) -> Column:
    safe = F.when(deviation > TINY, deviation)
    return F.coalesce(F.sqrt(F.lit(float(bars_per_year))) * mean / safe, F.lit(0.0))


def return_metrics(
    returns: DataFrame, keys: Sequence[str] = KEYS, bars_per_year: float = BARS_PER_YEAR
) -> DataFrame:
    """Bars, return, risk ratios, drawdown, 95% VaR and CVaR, and share of winning bars per group."""
    keys = list(keys)
    idx = ["idx"] if "idx" in returns.columns else []
    rows = returns.select(*keys, *idx, F.coalesce("return", F.lit(0.0)).alias("return"))
    out = distribution(rows, keys, "return", 0.05).join(drawdowns(rows, keys), keys)
    return out.select(
        *keys,
        F.col("count").alias("bars"),
        (ratio(F.col("growth"), F.col("first_growth")) - 1).alias("total_return"),
        F.col("mean").alias("expectancy"),
        _scaled(F.col("mean"), F.col("deviation"), bars_per_year).alias("sharpe"),
        _scaled(F.col("mean"), F.col("down_deviation"), bars_per_year).alias("sortino"),
        "max_drawdown",
        F.col("quantile").alias("var_95"),
        F.col("tail_mean").alias("cvar_95"),
        F.col("share_above").alias("bar_win_rate"),
    )


def turnover(returns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return returns.groupBy(*keys).agg(F.sum("turnover").alias("turnover"))


def trades(returns: DataFrame, capital: float = CAPITAL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of constant non-zero position, each closed by the bar on which the position changes.

    The exit bar belongs to the trade, so on a flip it counts in both; an open position
    closes on the last bar. A run that spans blocks is put together from its pieces: the
    run open at a block's start and the change that closes the run open at its end come
    from the table of blocks.
    """
    b = Blocks.of(returns, *keys)
    rows = returns.select(*keys, "idx", "date", "close", "position", F.coalesce("return", F.lit(0.0)).alias("return"))
    rows = b.halo(rows, back=1)
    changed = F.abs(F.col("position") - F.coalesce(F.lag("position").over(b.order), F.lit(0.0))) > TINY
    bar = F.struct("idx", "date", "close", "position", "return")
    rows = b.own(rows.withColumn("_at", F.when(changed, bar)))

    blocks = rows.groupBy(*keys, "_blk").agg(
        F.max("_at").alias("_last_at"), F.min("_at").alias("_first_at"), F.max(bar).alias("_end")
    )
    blocks = blocks.select(
        *keys,
        "_blk",
        F.last("_last_at", ignorenulls=True).over(b.earlier_blocks).alias("_open"),
        F.last("_first_at", ignorenulls=True).over(b.later_blocks).alias("_next"),
        F.max("_end").over(Window.partitionBy(*keys)).alias("_final"),
    )
    rows = rows.withColumns(
        {
            "_run": F.last("_at", ignorenulls=True).over(b.prefix),
            "_after": F.last("_at", ignorenulls=True).over(b.suffix),
        }
    ).join(blocks, [*keys, "_blk"])
    rows = rows.withColumns(
        {"_run": F.coalesce("_run", "_open"), "_exit": F.coalesce("_after", "_next")}
    ).where(F.abs("_run.position") > TINY)
    runs = rows.groupBy(*keys, "_run").agg(
        F.product(1 + F.col("return")).alias("_growth"),
        F.min("_exit").alias("_exit"),
        F.first("_final").alias("_final"),
    )
    closed = F.col("_exit").isNotNull()
    end = F.coalesce("_exit", "_final")
    growth = F.col("_growth") * F.when(closed, 1 + F.col("_exit.return")).otherwise(1.0)
    out = runs.select(
        *keys,
        F.col("_run.date").alias("entry_date"),
        end["date"].alias("exit_date"),
        F.when(F.col("_run.position") > 0, "LONG").otherwise("SHORT").alias("side"),
        F.col("_run.position").alias("entry_exposure"),
        F.when(closed, F.col("_exit.position")).otherwise(0.0).alias("exit_exposure"),
        F.col("_run.close").alias("entry_price"),
        end["close"].alias("exit_price"),
        (growth - 1).alias("return"),
        (end["idx"] - F.col("_run.idx") + 1).alias("bars_held"),
        F.when(~closed, "end_of_sample")
        .when(F.abs("_exit.position") > TINY, "signal_flip")
        .otherwise("signal_exit")
        .alias("exit_reason"),
    )
    return out.withColumn("pnl", capital * F.col("return"))


def risk_units(trade_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trade counts, gross profit and loss, and the mean loss that one R stands for."""
    pnl = F.coalesce("pnl", F.lit(0.0))
    return trade_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"),
        F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("_profit"),
        F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0)).alias("_loss"),
        F.coalesce(F.avg(F.when(pnl < 0, -pnl)), F.lit(0.0)).alias("_unit"),
        F.avg(pnl).alias("_mean"),
    )


def with_r_multiple(trade_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each trade's profit in units of the mean loss of its strategy; 0 when there are no losses."""
    units = risk_units(trade_rows, keys).select(*keys, "_unit")
    multiple = F.when(F.col("_unit") > TINY, F.coalesce("pnl", F.lit(0.0)) / F.col("_unit")).otherwise(0.0)
    return trade_rows.join(units, list(keys)).withColumn("r_multiple_proxy", multiple).drop("_unit")


def trade_summary(trade_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trade count, win rate, profit factor (infinite without losses) and expected R."""
    factor = (
        F.when(F.col("_loss") > TINY, F.col("_profit") / F.col("_loss"))
        .when(F.col("_profit") > 0, F.lit(float("inf")))
        .otherwise(0.0)
    )
    expected = F.when(F.col("_unit") > TINY, F.col("_mean") / F.col("_unit")).otherwise(0.0)
    return risk_units(trade_rows, keys).select(
        *keys, "num_trades", "win_rate", factor.alias("profit_factor"), expected.alias("expected_r")
    )


def with_trade_metrics(metrics: DataFrame, summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strategies without trades get zeros."""
    out = metrics.join(summary, list(keys), "left")
    return out.fillna(0, subset=["num_trades"]).fillna(0.0, subset=["win_rate", "profit_factor", "expected_r"])


def regime_metrics(returns: DataFrame, regimes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics on each regime's own bars; ``regimes`` has one row per bar with its filled label."""
    shared = [k for k in keys if k in regimes.columns]
    named = regimes.where(F.col("regime_id").isNotNull()).select(*shared, "idx", "regime_id", "regime_name")
    rows = returns.select(*keys, "idx", "return").join(named, [*shared, "idx"])
    out = return_metrics(rows, [*keys, "regime_id", "regime_name"])
    return out.withColumn("win_rate", F.col("bar_win_rate"))


@dataclass
class Backtest:
    returns: DataFrame
    equity: DataFrame
    metrics: DataFrame
    regime_metrics: DataFrame | None
    trades: DataFrame


def run_backtests(
    bars: DataFrame,
    signals: DataFrame,
    regimes: DataFrame | None = None,
    capital: float = CAPITAL,
    cost_bps: float = COST_BPS,
    keys: Sequence[str] = KEYS,
) -> Backtest:
    """Backtest every signal. The returns table is written once; all results read it.

    ``regimes`` is the bar table with filled labels (``signals.aligned_regimes``).
    """
    returns = staged(strategy_returns(bars, signals, cost_bps, keys))
    trade_rows = trades(returns, capital, keys)
    metrics = return_metrics(returns, keys).join(turnover(returns, keys), list(keys))
    return Backtest(
        returns=returns,
        equity=equity_curves(returns, capital, keys),
        metrics=with_trade_metrics(metrics, trade_summary(trade_rows, keys), keys),
        regime_metrics=None if regimes is None else regime_metrics(returns, regimes, keys),
        trades=with_r_multiple(trade_rows, keys),
    )
