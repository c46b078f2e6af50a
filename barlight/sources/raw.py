"""Raw minute records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.schema import RAW_MINUTES
from barlight.session import sized


def read_minute_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of raw records, needed columns only, all as text.

    Files may carry extra columns, in any order, but all in the same order: Spark takes the columns of all files by the place
    they have in the first, so a file with another header fails instead of giving wrong columns; ``read_minute_files`` reads
    such files. Types are never inferred; numbers are converted (and counted as missing when they
    cannot be) by ``barlight.operators.clean``.
    """
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if absent := [c for c in RAW_MINUTES.names if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    # The whole header is compared, so all columns must be asked for while the files are parsed.
    checked = spark.read.schema(rows.schema).option("header", True).option("enforceSchema", False).option("columnPruning", False).csv(path)
    return checked.select(*RAW_MINUTES.names)


def read_minute_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The same records kept as Parquet."""
    return spark.read.parquet(path).select(*[F.col(c) for c in RAW_MINUTES.names])


def read_minute_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV files whose headers may differ from file to file: raw records, all as text, and the lines that are none.

    A line that holds the names of the time and symbol columns is its file's header; columns are taken by name, others are
    left out, an empty field is null. Lines of a file without a header, with several unlike headers or without a needed column, and
    lines with another number of fields than their header, go to the quarantine with file, line and reason. Fields may be quoted, but
    hold no line ends.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    quoted = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    fields = F.when(F.contains("line", F.lit('"')), F.transform(quoted, _unquoted)).otherwise(F.split("line", ",", -1))
    lines = lines.withColumn("fields", fields)
    is_header = F.array_contains("fields", "ts_event") & F.array_contains("fields", "symbol")
    # One row for each file.
    headers = sized(lines.where(is_header).groupBy("file").agg(F.collect_set("fields").alias("headers")))
    rows = lines.where(~is_header).join(headers, "file", "left").withColumn("header", F.get("headers", F.lit(0)))
    missing = F.array_except(F.array(*map(F.lit, RAW_MINUTES.names)), "header")
    reason = (
        F.when(F.col("headers").isNull(), "no header")
        .when(F.size("headers") > 1, "several headers")
        .when(F.size(missing) > 0, F.concat(F.lit("no column "), F.array_join(missing, ", ")))
        .when(F.size("fields") != F.size("header"), F.concat(F.size("fields").cast("string"), F.lit(" fields of "), F.size("header").cast("string")))
    )
    rows = rows.withColumn("reason", reason)
    named = [F.nullif(F.get("fields", F.array_position("header", c).cast("int") - 1), F.lit("")).alias(c) for c in RAW_MINUTES.names]
    return rows.where(F.col("reason").isNull()).select(*named), rows.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(field, F.lit('"')) & F.endswith(field, F.lit('"')), inner).otherwise(field)
