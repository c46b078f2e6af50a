"""From raw minute records to clean bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.scalar import clock_minutes, contract_pattern, market_time, minute_of_day, utc_instant
from barlight.schema import BARS, OHLCV, PRICES


def outrights(records: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Keep outright contracts of the given root symbols and name the root."""
    root = F.coalesce(*[F.when(F.col("symbol").rlike(contract_pattern(r)), F.lit(r)) for r in roots])
    return records.withColumn("root", root).where(F.col("root").isNotNull())


def local_dates(records: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``utc`` and the naive market-time ``date``; unreadable times are dropped or raise."""
    out = records.withColumn("utc", utc_instant(F.col("ts_event")))
    if strict:
        message = F.concat(F.lit("unreadable time: "), F.coalesce(F.col("ts_event"), F.lit("null")))
        out = out.withColumn("utc", F.coalesce(F.col("utc"), F.raise_error(message).cast("timestamp_ntz")))
    return out.where(F.col("utc").isNotNull()).withColumn("date", market_time(F.col("utc")))


def date_range(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Both bounds are calendar days; the end day is included whole."""
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df


def session(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Half-open minute-of-day range; no filter when a bound is missing."""
    if start is None or end is None:
        return df
    minute = minute_of_day(F.col("date"))
    return df.where((minute >= clock_minutes(start)) & (minute < clock_minutes(end)))


def numeric(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    """Convert to double; rows with a missing or unreadable number go."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna(subset=list(columns))


def consistent(df: DataFrame) -> DataFrame:
    """high >= low, and open and close inside [low, high]."""
    low, high = F.col("low"), F.col("high")
    return df.where((high >= low) & F.col("open").between(low, high) & F.col("close").between(low, high))


def normalised(
    records: DataFrame,
    roots: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    session_start: str | None = None,
    session_end: str | None = None,
) -> DataFrame:
    """All row filters of the sample path."""
    rows = date_range(local_dates(outrights(records, roots)), start, end)
    return consistent(numeric(session(rows, session_start, session_end)))


def _first_of(df: DataFrame, by: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    """One row per ``by``: the one with the smallest ``order``; combines map-side."""
    best = F.min_by(F.struct(*keep), order).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, "_best.*")


def best_per_minute(rows: DataFrame) -> DataFrame:
    """Highest-volume contract at each minute; ties by contract name, then time and prices."""
    order = F.struct(-F.col("volume"), F.col("symbol"), F.col("utc"), *[F.col(c) for c in PRICES])
    best = _first_of(rows, ["root", "date"], order, OHLCV)
    return best.withColumnRenamed("root", "symbol").select(*BARS.names)


def sample_bars(records: DataFrame, root: str, sample_rows: int, **filters) -> DataFrame:
    """The first minutes by time, one contract per minute."""
    return best_per_minute(normalised(records, [root], **filters)).orderBy("date").limit(sample_rows)


def distinct_dates(df: DataFrame, keys: Sequence[str] = ("symbol",), ties: Sequence[str] = ("volume",)) -> DataFrame:
    """One row per key and date, the last one; ties are decided by the named columns."""
    keep = [c for c in df.columns if c not in (*keys, "date")]
    order = F.struct(*ties, *[c for c in keep if c not in ties])
    last = F.max_by(F.struct(*keep), order).alias("_last")
    return df.groupBy(*keys, "date").agg(last).select(*keys, "date", "_last.*")


def validated(df: DataFrame) -> DataFrame:
    """Clean bars: numbers present, prices consistent, one row per symbol and date."""
    rows = consistent(numeric(df.dropna(subset=["date"])))
    ties = [c for c in ("utc", "volume") if c in df.columns]
    return distinct_dates(rows, ties=ties).select(*BARS.names)


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost by validation, per symbol."""
    counts = before.groupBy("symbol").agg(F.count(F.lit(1)).alias("before"))
    left = after.groupBy("symbol").agg(F.count(F.lit(1)).alias("after"))
    kept = F.coalesce(F.col("after"), F.lit(0))
    return counts.join(left, "symbol", "left").select("symbol", (F.col("before") - kept).alias("rows_removed"))


def load_summary(bars: DataFrame) -> DataFrame:
    """Rows, trade days, first and last date per symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.to_date("date")).alias("trade_days"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("end_date"),
    )


def latest_dates(records: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Last local time on record per root symbol."""
    return local_dates(outrights(records, roots)).groupBy("root").agg(F.max("date").alias("latest"))


def trailing_years(bars: DataFrame, years: int, end: str | None = None) -> DataFrame:
    """Rows of the last ``years`` years before ``end`` (default: the last date on record, per symbol)."""
    if end is not None:
        start = F.add_months(F.lit(end).cast("date"), -12 * years)
        return date_range(bars.where(F.col("date") >= start.cast("timestamp_ntz")), None, end)
    last = bars.groupBy("symbol").agg(F.to_date(F.max("date")).alias("_end"))
    start = F.add_months("_end", -12 * years).cast("timestamp_ntz")
    return bars.join(last, "symbol").where(F.col("date") >= start).drop("_end")


