"""One continuous series per root symbol from its contracts.

Tables here are keyed by ``root`` and hold at most one row per calendar day, so a
window over a root is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlight.operators import clean
from barlight.schema import BARS, OHLCV, PRICES


def _days() -> WindowSpec:
    return Window.partitionBy("root").orderBy("trade_day")


def with_trade_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("trade_day", F.to_date("date"))


def daily_volume(rows: DataFrame) -> DataFrame:
    """Volume per contract and day."""
    return rows.groupBy("root", "trade_day", "symbol").agg(F.sum("volume").alias("volume"))


def dominant(volumes: DataFrame) -> DataFrame:
    """The day's contract: largest volume, ties by name."""
    order = F.struct(-F.col("volume"), F.col("symbol"))
    return volumes.groupBy("root", "trade_day").agg(
        F.min_by("symbol", order).alias("front_symbol"), F.max("volume").alias("volume")
    )


def switches(front: DataFrame) -> DataFrame:
    """Days on which the dominant contract differs from the day before on record."""
    old = F.lag("front_symbol").over(_days())
    changed = front.withColumn("old_symbol", old).where(F.col("old_symbol") != F.col("front_symbol"))
    return changed.select("root", "trade_day", "old_symbol", F.col("front_symbol").alias("new_symbol"))


_ROLL = ["root", "trade_day", "old_symbol", "new_symbol"]


def overlap(rows: DataFrame, front: DataFrame) -> DataFrame:
    """Closes of the old and the new contract side by side, per minute of each switch day."""
    order = F.struct(*[c for c in ("utc", "volume", "close") if c in rows.columns])

    def close_of(which: str):
        return F.max_by("close", F.when(F.col("symbol") == F.col(which), order)).alias(which.replace("symbol", "close"))

    day = rows.join(switches(front), ["root", "trade_day"])
    both = day.where((F.col("symbol") == F.col("old_symbol")) | (F.col("symbol") == F.col("new_symbol")))
    return both.groupBy(*_ROLL, "date").agg(close_of("old_symbol"), close_of("new_symbol"))


def roll_gaps(rows: DataFrame, front: DataFrame) -> DataFrame:
    """Price gap between the new and the old contract on each switch day.

    Median of new minus old close over the minutes both trade; without such minutes the
    first new minus the last old close. A day that lacks either contract gives no row.
    """
    gap = F.col("new_close") - F.col("old_close")
    gaps = overlap(rows, front).groupBy(*_ROLL).agg(
        F.percentile(gap, F.lit(0.5)).alias("_median"),
        F.min_by("new_close", F.when(F.col("new_close").isNotNull(), F.col("date"))).alias("_new"),
        F.max_by("old_close", F.when(F.col("old_close").isNotNull(), F.col("date"))).alias("_old"),
    )
    return gaps.where(F.col("_new").isNotNull() & F.col("_old").isNotNull()).select(
        *_ROLL,
        F.coalesce("_median", F.col("_new") - F.col("_old")).alias("roll_gap"),
        F.when(F.col("_median").isNotNull(), "median_overlap_close").otherwise("first_new_minus_last_old").alias("source"),
    )


def back_adjustments(front: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per day: the sum of the gaps of later switch days."""
    days = front.join(gaps.select("root", "trade_day", "roll_gap"), ["root", "trade_day"], "left")
    days = days.withColumn("roll_gap", F.coalesce("roll_gap", F.lit(0.0)))
    back = Window.partitionBy("root").orderBy(F.col("trade_day").desc())
    later = F.sum("roll_gap").over(back.rowsBetween(Window.unboundedPreceding, -1))
    return days.select("root", "trade_day", "roll_gap", F.coalesce(later, F.lit(0.0)).alias("back_adjustment"))


def front_rows(rows: DataFrame, front: DataFrame) -> DataFrame:
    """Rows of the day's dominant contract, one per date, under the root symbol."""
    chosen = front.select("root", "trade_day", F.col("front_symbol").alias("symbol"))
    kept = rows.join(chosen, ["root", "trade_day", "symbol"]).drop("symbol", "trade_day")
    ties = [c for c in ("utc", "volume") if c in kept.columns]
    return clean.distinct_dates(kept.withColumnRenamed("root", "symbol"), ties=ties).select(*BARS.names)


def adjusted(series: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Add the day's adjustment to the four prices; days without one stay as they are."""
    days = adjustments.select(F.col("root").alias("symbol"), "trade_day", "back_adjustment")
    out = with_trade_day(series).join(days, ["symbol", "trade_day"], "left")
    shift = F.coalesce("back_adjustment", F.lit(0.0))
    return out.withColumns({c: F.col(c) + shift for c in PRICES}).select(*BARS.names)


def stitch(rows: DataFrame, back_adjust: bool = True) -> DataFrame:
    """Continuous series from local-time rows that carry ``root``."""
    rows = with_trade_day(rows)
    front = dominant(daily_volume(rows))
    series = front_rows(rows, front)
    return adjusted(series, back_adjustments(front, roll_gaps(rows, front))) if back_adjust else series


def front_series(
    records: DataFrame,
    roots: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    session_start: str | None = None,
    session_end: str | None = None,
    back_adjust: bool = True,
) -> DataFrame:
    """Full load: raw records to the back-adjusted, validated series of each root."""
    rows = clean.local_dates(clean.outrights(records, roots), strict=True)
    rows = clean.session(clean.date_range(rows, start, end), session_start, session_end)
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in OHLCV})
    return clean.validated(stitch(rows, back_adjust))
