"""Bar tables derived from the events table, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.functions.scalar import bucket_end
from barlight.operators.ordered import with_ordinal
from checks.registry import view

MINUTE = 60_000_000


def price() -> Column:
    return 100 + F.col("value") / 20


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _bars(rows: DataFrame, p: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "date").agg(
        F.min_by(p, "ts").alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """One price series per event type."""
    rows = events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), bucket_end(F.col("ts"), minutes * MINUTE).alias("date"), "ts", "value"
    )
    return _bars(rows, price(), "symbol")


def indexed(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    return with_ordinal(bars(spark, sf_dir, minutes))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly records of four outright contracts and one spread."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "NQH4").when(kind == "error", "NQM4").when(kind == "purchase", "NQU4")
        .when(kind == "signup", "NQZ4").otherwise("NQH4-NQM4")
    )
    lift = F.when(kind == "error", 8).when(kind == "purchase", 16).when(kind == "signup", 24).otherwise(0)
    rows = events(spark, sf_dir).select(
        name.alias("symbol"), bucket_end(F.col("ts"), 60 * MINUTE).alias("date"), "ts", (price() + lift).alias("price")
    )
    return _bars(rows, F.col("price"), "symbol")


def raw_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text records, one per event, some of them unreadable or inconsistent."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "NQH4").when(kind == "error", "NQM4").when(kind == "purchase", "NQU4")
        .when(kind == "signup", "NQZ4").otherwise("NQH4-NQM4")
    )
    minute = F.date_trunc("MINUTE", F.col("ts"))
    base = F.round(price(), 6)
    return events(spark, sf_dir).select(
        F.when(F.col("value") > 200, "not a time").otherwise(F.date_format(minute, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts_event"),
        base.cast("string").alias("open"),
        (base + 1).cast("string").alias("high"),
        (base - 1).cast("string").alias("low"),
        (base + (F.second("ts") - 30) / 25).cast("string").alias("close"),
        F.when(F.col("value") < 2, "n/a").otherwise(F.col("user_id").cast("string")).alias("volume"),
        name.alias("symbol"),
    )


def _bucket(minutes: int) -> str:
    m = minutes * MINUTE
    return f"make_timestamp((epoch_us(ts) + {m} - 1) // {m} * {m})"


_OHLCV = """min_by({p}, ts) AS open, max({p}) AS high, min({p}) AS low, max_by({p}, ts) AS close,
CAST(count(*) AS DOUBLE) AS volume"""

for _m in (1, 15):
    view(
        f"bars{_m}",
        f"SELECT event_type AS symbol, {_bucket(_m)} AS date, {_OHLCV.format(p='(100 + value/20)')} FROM events GROUP BY 1, 2",
    )
    view(
        f"idx{_m}",
        f"SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS BIGINT) AS idx FROM bars{_m}",
    )

_NAME = """CASE event_type WHEN 'click' THEN 'NQH4' WHEN 'error' THEN 'NQM4' WHEN 'purchase' THEN 'NQU4'
WHEN 'signup' THEN 'NQZ4' ELSE 'NQH4-NQM4' END"""

view(
    "contracts60",
    f"""SELECT symbol, date, {_OHLCV.format(p='price')} FROM (SELECT ts, {_bucket(60)} AS date, {_NAME} AS symbol,
100 + value/20 + CASE event_type WHEN 'error' THEN 8 WHEN 'purchase' THEN 16 WHEN 'signup' THEN 24 ELSE 0 END AS price
FROM events) t GROUP BY 1, 2""",
)

view(
    "raw_minutes",
    f"""SELECT CASE WHEN value > 200 THEN 'not a time' ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') END AS ts_event,
CAST(p AS VARCHAR) AS open, CAST(p + 1 AS VARCHAR) AS high, CAST(p - 1 AS VARCHAR) AS low,
CAST(p + (second(ts) - 30) / 25 AS VARCHAR) AS close,
CASE WHEN value < 2 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS volume, {_NAME} AS symbol
FROM (SELECT *, round(100 + value/20, 6) AS p FROM events) e""",
)
