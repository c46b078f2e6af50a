"""Higher-timeframe bars and their backward as-of join to the base bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.scalar import bucket_end
from barlight.session import staged

FIVE_MINUTES, DAY, WEEK = "5min", "1D", "W-FRI"


def bucket_label(date: Column, rule: str) -> Column:
    """Right label of the right-closed bin.

    Midnight belongs to the day before, and is labelled with its own date. A week is
    labelled with its Friday, takes that whole Friday in, and ends with it.
    """
    if rule == FIVE_MINUTES:
        return bucket_end(date, 300_000_000)
    if rule == DAY:
        return bucket_end(date, 86_400_000_000)
    if rule == WEEK:
        return F.next_day(F.date_sub(F.to_date(date), 1), "FRI").cast("timestamp_ntz")
    raise ValueError(f"unknown rule {rule!r}")


def resampled(bars: DataFrame, rule: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV per bin; bins without rows do not appear."""
    rows = bars.withColumn("label", bucket_label(F.col("date"), rule))
    return (
        rows.groupBy(*keys, "label")
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("label", "date")
    )


def partials(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV records from which the bins of every rule are put together, so that bars are read once for all of them.

    A record is a five-minute bin, cut once more where a calendar day ends inside it: days and bins end on five-minute
    edges, but a week ends with its Friday, so midnight itself is the next week's. ``date`` is the record's last bar.
    """
    return bars.groupBy(*keys, bucket_label(F.col("date"), FIVE_MINUTES).alias("_five"), F.to_date("date").alias("_day")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("date").alias("_first"),
        F.max("date").alias("date"),
    )


def rolled_up(records: DataFrame, rule: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV per bin of the rule from ``partials``; the same rows as ``resampled`` gives from the bars."""
    return (
        records.groupBy(*keys, bucket_label(F.col("date"), rule).alias("_label"))
        .agg(
            F.min_by("open", "_first").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_label", "date")
    )


def asof_backward(left: DataFrame, rights: dict[str, DataFrame], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Attach to each left row the last row of every right table at or before its date.

    Each right table arrives as one struct column under its name. The right tables are written once, as one table that both
    passes read. Left and right rows are scanned once per (key, day); what holds at the start of a day is one more row
    in front of them, from a table of one row per key and day, so no key is scanned in one task.
    """
    names = list(rights)
    payload = [c for c in left.columns if c not in (*keys, "date")]
    context = None
    for n, r in rights.items():
        part = r.select(*keys, "date", F.to_date("date").alias("_day"), F.struct(*[c for c in r.columns if c not in keys]).alias(n))
        context = part if context is None else context.unionByName(part, allowMissingColumns=True)
    context = staged(context)

    left = left.withColumn("_day", F.to_date("date"))
    wanted = left.select(*keys, "_day").distinct().unionByName(context.select(*keys, "_day", "date", *names), allowMissingColumns=True)
    days = wanted.groupBy(*keys, "_day").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("date"))).alias(n) for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select(
        *keys, "_day", F.col("_day").cast(left.schema["date"].dataType).alias("date"), F.lit(-1).alias("_side"),
        *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names],
    )
    rows = left.select(*keys, "date", "_day", F.lit(1).alias("_side"), F.struct(*payload).alias("_left"))
    rows = rows.unionByName(context.withColumn("_side", F.lit(0)).unionByName(opening), allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "_day").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = rows.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names})
    return seen.where(F.col("_side") == 1).select(*keys, "date", "_left.*", *names)
