"""Registry of checked queries: the Spark side and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.session import staged


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Marks rounding by size: 9 decimals below 1, 5 above. Costs are quarter basis points, whose
# halves and quarters sit exactly between two values of 6 or 7 decimals.
METRIC = 6

CHECKS: dict[str, Check] = {}
VIEWS: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        CHECKS[name] = Check(run, with_views(sql) if sql else None)
        return fn

    return register


def view(name: str, body: str) -> None:
    VIEWS[name] = body


def with_views(body: str) -> str:
    """Put the named views a statement uses in front of it as WITH clauses, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed) + "\n" + body


_SHARED: dict[tuple, object] = {}


def _still_there(spark: SparkSession, made: object) -> bool:
    """Whether the folders that a shared intermediate reads still hold their files; someone may clear them between queries."""
    values = [made] if isinstance(made, DataFrame) else made if isinstance(made, tuple) else (made if isinstance(made, dict) else vars(made)).values()
    files = [f for v in values if isinstance(v, DataFrame) for f in v.inputFiles()]
    first = {f.rpartition("/")[0]: f for f in files}
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in first.values()]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def shared(fn):
    """Write an intermediate once per session and data folder, as a saved run would hold it."""

    def load(spark: SparkSession, sf_dir: str, *rest):
        key = (spark.sparkContext.applicationId, sf_dir, fn.__module__, fn.__name__, *rest)
        if key not in _SHARED or not _still_there(spark, _SHARED[key]):
            made = fn(spark, sf_dir, *rest)
            _SHARED[key] = staged(made) if isinstance(made, DataFrame) else made
        return _SHARED[key]

    return load


def forget() -> None:
    """Drop the shared intermediates, so the next query does all its work itself."""
    _SHARED.clear()


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round every double column and drop the sign of zero, as the SQL side does with rnd()."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        if kind == "double":
            d = special.get(name, digits)
            value = F.col(f"`{name}`")
            value = F.when(F.abs(value) < 1, F.round(value, 9)).otherwise(F.round(value, 5)) if d == METRIC else F.round(value, d)
            value = F.when(F.col(f"`{name}`") == float("inf"), F.col(f"`{name}`")).otherwise(value)
            out.append((value + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def rnd(expr: str, digits: int = 8) -> str:
    if digits == METRIC:
        return f"(CASE WHEN abs({expr}) < 1 THEN round({expr}, 9) ELSE round({expr}, 5) END + 0.0)"
    return f"(round({expr}, {digits}) + 0.0)"


def rnds(*names: str, digits: int = 8) -> str:
    """Select list that rounds plain columns."""
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)
