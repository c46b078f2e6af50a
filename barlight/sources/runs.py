"""Saved runs: result tables, the catalogue of runs and models, and reading them back."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from barlight.functions.scalar import display_label, slug

# The kinds of table a run may hold.
TABLES = [
    "bars", "regime_labels", "regime_features", "regime_stats", "regime_transitions", "regime_stability",
    "price_regimes", "strategy_signals", "strategy_returns", "equity_curves", "metrics", "per_regime_metrics",
    "trades", "stress_summary", "monte_carlo_paths", "oos_regime_labels", "oos_regime_model_rankings",
    "oos_regime_blocks", "strategy_metrics_oos", "strategy_per_regime_metrics_oos", "strategy_regime_rankings_oos",
    "models", "runs", "monte_carlo_bands", "monte_carlo_terminal", "skipped_models", "unfiltered_blocks",
]
CATALOGUE = ["models", "runs", "skipped_models"]  # one set of rows per run, not per model
PRIMARY_ROWS = 100_000
SCHEMAS = "_schemas"  # columns of tables that were written without rows


class RunStore:
    """Result tables under one folder, one Parquet table per kind, partitioned by run and model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, table: str, df: DataFrame, run_id: str, model_id: str = "") -> None:
        """Replace this run's and model's part of the table; running it again gives the same files."""
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}")
        rows = df.withColumn("run_id", F.lit(run_id))
        if table in CATALOGUE:
            self._save(table, rows, ["run_id"])
        else:
            self._save(table, rows.withColumn("model_id", F.lit(model_id or "-")), ["run_id", "model_id"])

    def write_by_model(self, table: str, df: DataFrame, run_id: str) -> None:
        """The same for rows that carry their own ``model_id``."""
        if table not in TABLES or table in CATALOGUE:
            raise ValueError(f"no model table {table!r}")
        self._save(table, df.withColumn("run_id", F.lit(run_id)), ["run_id", "model_id"])

    def _save(self, table: str, rows: DataFrame, parts: list[str]) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(f"{self.root}/{table}")
        )
        if self._files(table) is None:  # nothing but empty tables so far: no file tells the columns
            text = self.spark.createDataFrame([(rows.schema.json(),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{self.root}/{SCHEMAS}/{table}")

    def _files(self, table: str) -> DataFrame | None:
        """The table as far as files hold it."""
        return _known(lambda: self.spark.read.parquet(f"{self.root}/{table}"))

    def _table(self, table: str, otherwise: str) -> DataFrame:
        """The table; without rows one with the columns it was last written with, or, if it never was, those given."""
        found = self._files(table)
        if found is not None:
            return found
        saved = _known(lambda: self.spark.read.text(f"{self.root}/{SCHEMAS}/{table}"))
        schema = otherwise if saved is None else StructType.fromJson(json.loads(saved.first()["value"]))
        return self.spark.createDataFrame([], schema)

    def write_csv(self, table: str, df: DataFrame, run_id: str, model_id: str = "") -> None:
        """The same table as header CSV files, for readers without Parquet."""
        folder = f"{self.root}/csv/{table}/run_id={run_id}/model_id={(model_id or '-').replace(':', '_')}"
        df.write.mode("overwrite").option("header", True).csv(folder)

    def read(self, table: str, run_id: str, model_id: str | None = None) -> DataFrame:
        """The run's table for the wanted model. One that was written without rows keeps its columns, one that never was has only its keys."""
        rows = self._table(table, "run_id string, model_id string").where(F.col("run_id") == run_id)
        if table in CATALOGUE:
            return rows
        on = [c for c in ("symbol", "model_id") if c in rows.columns]
        return rows.join(selected_model(self.read("models", run_id), model_id).select(*on).distinct(), on, "left_semi")

    def manifests(self) -> DataFrame:
        """One row per saved run, as ``available_runs`` wants it: mode, bars, when it was saved, whether its main tables are there."""
        rows = self._all("runs").groupBy("run_id", "mode").agg(F.sum("rows").alias("rows"), F.max("created_at").alias("modified"))
        found = F.lit(True)
        for table in ("metrics", "equity_curves"):
            saved = self._all(table).select("run_id").distinct().withColumn(f"_{table}", F.lit(True))
            rows, found = rows.join(saved, "run_id", "left"), found & F.coalesce(f"_{table}", F.lit(False))
        return rows.select("run_id", "mode", "rows", "modified", found.alias("has_tables"))

    def _all(self, table: str) -> DataFrame:
        return self._table(table, "run_id string, mode string, rows bigint, created_at timestamp")

    def load(self, run_id: str, model_id: str | None = None) -> dict[str, DataFrame]:
        """All tables of a run for one model."""
        return {t: self.read(t, run_id, model_id) for t in TABLES}


def _known(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What is read, or nothing where no file is there."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def selected_model(models: DataFrame, model_id: str | None = None) -> DataFrame:
    """The wanted model when the run has it, else the recommended one, else the first by rank."""
    wanted = F.lit(False) if model_id is None else F.col("model_id") == model_id
    order: list[Column] = [wanted.desc(), F.col("is_best").desc(), F.col("rank"), F.col("model_id")]
    place = F.row_number().over(Window.partitionBy("run_id", "symbol").orderBy(*order))
    return models.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def model_catalogue(
    scores: DataFrame,
    by: str,
    source: str,
    keys: Sequence[str] = ("symbol",),
    selected: Column | None = None,
) -> DataFrame:
    """One row per tried model: id, label, folder name, score, rank and the recommended mark."""
    model_id = F.concat_ws("::", "candidate", "model_family")
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), "candidate", "model_family")
    rows = scores.withColumn("model_id", model_id).withColumn("rank", F.row_number().over(order))
    best = F.col("rank") == 1 if selected is None else selected
    return rows.select(
        *keys, "model_id", display_label(F.col("model_id")).alias("display_label"), slug(F.col("model_id")).alias("folder"),
        "candidate", "model_family", F.lit(source).alias("recommendation_source"), F.lit(by).alias("rank_metric"),
        F.coalesce(F.col(by), F.lit(0.0)).alias("rank_value"), "rank", best.alias("is_best"),
    )


def run_row(summary: DataFrame, run_id: str, mode: str, **settings) -> DataFrame:
    """The run's manifest: load summary per symbol plus the settings as JSON."""
    return summary.select(
        F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), "*", F.current_timestamp().alias("created_at"),
        F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(settings.items()) for x in kv])).alias("settings")
        if settings else F.lit("{}").alias("settings"),
    )


def available_runs(manifests: DataFrame, include_all: bool = False, primary_rows: int = PRIMARY_ROWS) -> DataFrame:
    """Runs for the picker: primary ones first, then full ones, larger and newer first.

    Primary: full mode, enough rows, metric and equity tables present, no 'smoke' in the name.
    """
    primary = (
        (F.col("mode") == "full") & F.col("has_tables") & (F.col("rows") >= primary_rows)
        & ~F.contains(F.lower("run_id"), F.lit("smoke"))
    )
    rows = manifests.withColumns({"is_primary": primary, "is_full": F.col("mode") == "full"})
    if not include_all:
        rows = rows.where("is_primary")
    return rows.orderBy(F.col("is_primary").desc(), F.col("is_full").desc(), F.col("rows").desc(), F.col("modified").desc())
