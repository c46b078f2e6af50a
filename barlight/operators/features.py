"""Feature families over bars keyed by (symbol, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlight.functions import rolling
from barlight.functions.scalar import ratio, row_mean
from barlight.operators.ordered import Blocks, with_ordinal
from barlight.operators.resample import DAY, FIVE_MINUTES, WEEK, asof_backward, partials, resampled, rolled_up
from barlight.session import staged

SHORT, LONG = 30, 120
MINUTE, SCRIPTED, MULTI, HYBRID = (
    "minute_volatility_trend_kmeans",
    "rolling_return_volatility_kmeans",
    "multi_timeframe_volatility_trend_kmeans",
    "hybrid_minute_multi_timeframe_kmeans",
)
ID = ["symbol", "idx", "date"]
MINUTE_COLUMNS = ["rolling_vol_short", "rolling_vol_long", "abs_return", "trend_strength", "momentum", "range_pct"]
SCRIPTED_COLUMNS = [
    "script_vol_fast", "script_vol_slow", "script_absret_mean", "script_trend_strength",
    "script_directional_persistence", "script_range_pct",
]
FRAMES = {"i5": (FIVE_MINUTES, 12, 288), "daily": (DAY, 5, 60), "weekly": (WEEK, 4, 26)}
_PARTS = ["vol_short", "vol_long", "trend_short", "trend_long", "range_pct"]
MULTI_COLUMNS = [f"{p}_{c}" for p in FRAMES for c in _PARTS]
COLUMNS = {
    MINUTE: MINUTE_COLUMNS + ["vol_axis", "structure_axis"],
    SCRIPTED: SCRIPTED_COLUMNS + ["vol_axis", "structure_axis"],
    MULTI: MULTI_COLUMNS + ["vol_axis", "structure_axis"],
    HYBRID: MINUTE_COLUMNS + ["vol_axis", "structure_axis"] + MULTI_COLUMNS,
}
CLASSIFIER_COLUMNS = ["ret_1", "ret_5", "ret_20", "vol_20", "vol_80", "range_pct", "rsi", "volume_z"]


def log_return(order: WindowSpec) -> Column:
    close = F.col("close")
    return F.ln(close) - F.ln(F.lag(close).over(order))


def pct_change(x: Column, n: int, order: WindowSpec) -> Column:
    return ratio(x, F.lag(x, n).over(order)) - 1


def bar_range() -> Column:
    return ratio(F.col("high") - F.col("low"), F.col("close"))


def minute_features(bars: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Volatility, trend strength and momentum of the bars themselves."""
    b = Blocks.of(bars)
    rows = b.halo(bars.select(*ID, "high", "low", "close"), back=long + 1)
    rows = rows.withColumn("log_return", log_return(b.order))
    r, close = F.col("log_return"), F.col("close")
    s, n = b.last(short), b.last(long)
    rows = rows.withColumns(
        {
            "rolling_vol_short": rolling.deviation(r, s, max(10, short // 4)),
            "rolling_vol_long": rolling.deviation(r, n, max(20, long // 4)),
            "abs_return": rolling.mean(F.abs(r), s, max(10, short // 4)),
            "trend_strength": F.abs(rolling.zscore(close, n, max(5, long // 4))),
            "momentum": pct_change(close, long, b.order),
            "range_pct": bar_range(),
        }
    )
    return b.own(rows).select(
        *ID, "log_return", *MINUTE_COLUMNS,
        row_mean([F.col("rolling_vol_long"), F.col("abs_return"), F.col("range_pct")]).alias("vol_axis"),
        row_mean([F.abs("trend_strength"), F.abs("momentum")]).alias("structure_axis"),
    )


def scripted_features(bars: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Slower rolling returns and volatility, with directional persistence."""
    b = Blocks.of(bars)
    fast, slow = max(short * 2, 60), max(long * 2, 240)
    rows = b.halo(bars.select(*ID, "high", "low", "close"), back=slow + 1)
    rows = rows.withColumn("log_return", log_return(b.order))
    r, f, s = F.col("log_return"), b.last(fast), b.last(slow)
    rows = rows.withColumns(
        {
            "script_vol_fast": rolling.deviation(r, f, max(20, fast // 4)),
            "script_vol_slow": rolling.deviation(r, s, max(30, slow // 4)),
            "script_absret_mean": rolling.mean(F.abs(r), f, max(20, fast // 4)),
            "script_trend_strength": F.abs(pct_change(F.col("close"), slow, b.order)),
            "script_directional_persistence": F.abs(rolling.mean(F.signum(r), f, max(20, fast // 4))),
            "script_range_pct": bar_range(),
        }
    )
    return b.own(rows).select(
        *ID, "log_return", *SCRIPTED_COLUMNS,
        row_mean([F.col(c) for c in ("script_vol_slow", "script_absret_mean", "script_range_pct")]).alias("vol_axis"),
        row_mean([F.col("script_trend_strength"), F.col("script_directional_persistence")]).alias("structure_axis"),
    )


def _timeframe_columns(prefix: str, short: int, long: int, order: WindowSpec) -> dict[str, Column]:
    r = F.col("_r")
    s, n = order.rowsBetween(-(short - 1), 0), order.rowsBetween(-(long - 1), 0)
    least_s, least_n = max(2, short // 3), max(3, long // 3)
    return {
        f"{prefix}_vol_short": rolling.deviation(r, s, least_s),
        f"{prefix}_vol_long": rolling.deviation(r, n, least_n),
        f"{prefix}_trend_short": rolling.total(r, s, least_s),
        f"{prefix}_trend_long": rolling.total(r, n, least_n),
        f"{prefix}_range_pct": bar_range(),
    }


def timeframe_features(bars: DataFrame, prefix: str, records: DataFrame | None = None) -> DataFrame:
    """Volatility and trend of one higher timeframe, shifted by one completed bar.

    ``records`` are ``partials`` of the bars, where several timeframes share them. Daily and weekly tables hold at most one row per symbol and calendar day, so a plain
    window is bounded; the five-minute table goes through blocks.
    """
    rule, short, long = FRAMES[prefix]
    table = resampled(bars, rule) if records is None else rolled_up(records, rule)
    if rule == FIVE_MINUTES:
        table = with_ordinal(table)
        b = Blocks.of(table)
        rows, order = b.halo(table, back=long + 2), b.order
    else:
        b, rows, order = None, table, Window.partitionBy("symbol").orderBy("date")
    rows = rows.withColumn("_r", log_return(order))
    rows = rows.withColumns(_timeframe_columns(prefix, short, long, order))
    names = [f"{prefix}_{c}" for c in _PARTS]
    rows = rows.withColumns({c: F.lag(c).over(order) for c in names})
    return (b.own(rows) if b else rows).select("symbol", "date", *names)


def multi_timeframe_features(bars: DataFrame) -> DataFrame:
    """Last completed five-minute, daily and weekly context of every bar."""
    records = staged(partials(bars))
    tables = {p: timeframe_features(bars, p, records) for p in FRAMES}
    joined = asof_backward(bars.select(*ID), tables)
    rows = joined.select(*ID, *[F.col(f"{p}.{p}_{c}") for p in FRAMES for c in _PARTS])
    vol = [c for c in MULTI_COLUMNS if c.endswith(("vol_short", "vol_long", "range_pct"))]
    trend = [c for c in MULTI_COLUMNS if "trend_" in c]
    return rows.select(
        "*",
        row_mean([F.col(c) for c in vol]).alias("vol_axis"),
        row_mean([F.abs(c) for c in trend]).alias("structure_axis"),
    )


def hybrid_features(minute: DataFrame, multi: DataFrame) -> DataFrame:
    """Both families side by side; the axes average all their volatility and trend columns."""
    rows = minute.join(multi.drop("date", "vol_axis", "structure_axis"), ["symbol", "idx"], "left")
    names = MINUTE_COLUMNS + ["vol_axis", "structure_axis"] + MULTI_COLUMNS
    vol = [c for c in names if "vol" in c or c.endswith("range_pct")]
    trend = [c for c in names if "trend" in c or "momentum" in c or "directional" in c]
    axes = {
        "vol_axis": row_mean([F.col(c) for c in vol]),
        "structure_axis": row_mean([F.abs(c) for c in trend]),
    }
    return rows.withColumns(axes).select(*ID, "log_return", *names)


def candidate_features(bars: DataFrame, short: int = SHORT, long: int = LONG) -> dict[str, DataFrame]:
    """The four feature families that compete for the regime model."""
    minute, multi = minute_features(bars, short, long), multi_timeframe_features(bars)
    return {
        MINUTE: minute,
        SCRIPTED: scripted_features(bars, short, long),
        MULTI: multi,
        HYBRID: hybrid_features(minute, multi),
    }


def price_change(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Split the close-to-close change into a gain and a loss."""
    change = F.col("close") - F.lag("close").over(order)
    return rows.withColumns(
        {"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
         "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    )


def classifier_columns(b: Blocks) -> dict[str, Column]:
    """Classifier inputs; rows must carry ``log_return``, ``_gain`` and ``_loss``."""
    r, volume, long = F.col("log_return"), F.col("volume"), b.last(80)
    return {
        "ret_1": r,
        "ret_5": rolling.total(r, b.last(5), 3),
        "ret_20": rolling.total(r, b.last(20), 10),
        "vol_20": rolling.deviation(r, b.last(20), 10),
        "vol_80": rolling.deviation(r, long, 20),
        "range_pct": bar_range(),
        "rsi": rolling.rsi(F.col("_gain"), F.col("_loss"), b.last(14), 14),
        "volume_z": rolling.zscore(volume, long, 20),
    }


def classifier_features(bars: DataFrame) -> DataFrame:
    """Inputs and next-bar target of the classifiers."""
    b = Blocks.of(bars)
    rows = b.halo(bars.select(*ID, "high", "low", "close", "volume"), back=81, ahead=1)
    rows = price_change(rows.withColumn("log_return", log_return(b.order)), b.order)
    following = F.lead("close").over(b.order)
    target = F.coalesce(ratio(following, F.col("close")) - 1 > 0, F.lit(False)).cast("int")
    rows = rows.withColumns({**classifier_columns(b), "target": target})
    return b.own(rows).select(*ID, *CLASSIFIER_COLUMNS, "target")
