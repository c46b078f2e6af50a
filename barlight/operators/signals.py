"""Strategy signals: one number in [-1, 1] per bar and strategy, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions import rolling
from barlight.functions.scalar import clipped_signal
from barlight.operators.features import price_change
from barlight.operators.ordered import Blocks, forward_fill
from barlight.schema import RISK_REGIMES, STRATEGIES

RULES = ["sma_cross", "donchian", "rsi_mr", "zscore_mr"]


def _side(buy: Column, sell: Column) -> Column:
    """1 on buy, -1 on sell, else 0; an unknown condition counts as not met."""
    return F.when(sell, -1.0).when(buy, 1.0).otherwise(0.0)


def sma_cross(b: Blocks, short: int = 20, long: int = 80) -> Column:
    close = F.col("close")
    gap = rolling.mean(close, b.last(short), max(5, short // 2)) - rolling.mean(close, b.last(long), max(10, long // 2))
    return F.signum(clipped_signal(gap))


def donchian(b: Blocks, n: int = 60) -> Column:
    least = max(10, n // 2)
    high = rolling.gated(F.max, F.col("high"), b.before(n), least)
    low = rolling.gated(F.min, F.col("low"), b.before(n), least)
    return _side(F.col("close") > high, F.col("close") < low)


def rsi_reversion(b: Blocks, n: int = 14) -> Column:
    """Rows must carry ``_gain`` and ``_loss``."""
    rsi = rolling.rsi(F.col("_gain"), F.col("_loss"), b.last(n), n)
    return _side(rsi < 30.0, rsi > 70.0)


def zscore_reversion(b: Blocks, n: int = 80, threshold: float = 1.25) -> Column:
    z = rolling.zscore(F.col("close"), b.last(n), max(10, n // 2))
    return _side(z < -threshold, z > threshold)


def liquidity_mask(b: Blocks, n: int = 60) -> Column:
    """1 where volume and range both reach their rolling medians."""
    least, span = max(10, n // 2), F.abs(F.col("high") - F.col("low"))
    liquid = (F.col("volume") >= rolling.median(F.col("volume"), b.last(n), least)) & (
        span >= rolling.median(span, b.last(n), least)
    )
    return F.when(liquid, 1.0).otherwise(0.0)


def base_signals(
    bars: DataFrame,
    short: int = 20,
    long: int = 80,
    breakout: int = 60,
    reversion: int = 80,
    strategies: Sequence[str] = tuple(RULES),
) -> DataFrame:
    """Rule signals and the liquidity mask, one column each, from one pass over the bars."""
    b = Blocks.of(bars)
    back = max(short, long, breakout + 1, reversion, 15)
    rows = b.halo(bars.select("symbol", "idx", "date", "high", "low", "close", "volume"), back=back)
    rows = price_change(rows, b.order)
    made = {
        "sma_cross": sma_cross(b, short, long),
        "donchian": donchian(b, breakout),
        "rsi_mr": rsi_reversion(b),
        "zscore_mr": zscore_reversion(b, reversion),
    }
    picked = {s: made[s] for s in RULES if s in strategies}
    rows = rows.withColumns({**picked, "liquid": liquidity_mask(b, breakout)})
    return b.own(rows).select("symbol", "idx", "date", "close", *picked, "liquid")


def aligned_regimes(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Every bar with its regime; bars without a label keep the last one, the first have none."""
    named = labels.select("symbol", "idx", "regime_id", "regime_name")
    rows = bars.join(named, ["symbol", "idx"], "left")
    return forward_fill(rows, ["regime_id", "regime_name"], Blocks.of(bars))


def risk_multiplier(name: Column) -> Column:
    """Half size in the two high-volatility regimes."""
    return F.when(name.isin(RISK_REGIMES), 0.5).otherwise(1.0)


def variants(base: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Long signals: every base strategy as it is, sized by regime, and masked by liquidity.

    ``base`` holds one column per strategy plus ``multiplier`` and ``liquid``.
    """
    cells = []
    for s in strategies:
        x = clipped_signal(F.col(s))
        cells += [
            F.struct(F.lit(f"{s}__baseline").alias("strategy"), x.alias("signal")),
            F.struct(F.lit(f"{s}__regime_aware").alias("strategy"), clipped_signal(x * F.col("multiplier")).alias("signal")),
            F.struct(F.lit(f"{s}__liquidity_filtered").alias("strategy"), clipped_signal(x * F.col("liquid")).alias("signal")),
        ]
    close = ["close"] if "close" in base.columns else []
    return base.select("symbol", "idx", "date", *close, F.inline(F.array(*cells)))


def strategy_signals(
    bars: DataFrame,
    labels: DataFrame | None = None,
    learned: DataFrame | None = None,
    strategies: Sequence[str] = tuple(STRATEGIES),
    **windows: int,
) -> DataFrame:
    """All variants of the wanted strategies.

    ``learned`` is a wide table (symbol, idx, one column per learned strategy), as made
    by ``classify.learned_signals``.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    base = base_signals(bars, strategies=strategies, **windows)
    if learned is not None:
        base = base.join(learned.drop("date"), ["symbol", "idx"], "left")
    if labels is None:
        base = base.withColumn("multiplier", F.lit(1.0))
    else:
        base = aligned_regimes(base, labels).withColumn("multiplier", risk_multiplier(F.col("regime_name")))
    return variants(base, [s for s in STRATEGIES if s in strategies and s in base.columns])


def wide_signals(signals: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One column per strategy, missing cells 0."""
    wide = signals.groupBy("symbol", "date").pivot("strategy", list(strategies)).agg(F.first("signal"))
    return wide.fillna(0.0, subset=list(strategies))
