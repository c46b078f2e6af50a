"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "barlight") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SEEN: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the warehouse; in local mode, without the former, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and _one_process(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barlight-"))
        folder = spark.sparkContext.getCheckpointDir()
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    _refuse_own_disks(spark, folder)
    return folder


def _one_process(spark: SparkSession) -> bool:
    """Whether the driver runs the tasks itself; local-cluster has executors of its own."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def _refuse_own_disks(spark: SparkSession, folder: str) -> None:
    """A path of the local file system may be a shared mount or each machine's own disk: what tasks write there must come back.

    On own disks the driver would find none of their files and later reads would be empty. Tried once for
    each application and folder, with a row for each core.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key in _SEEN or _one_process(spark) or spark.conf.get("spark.barlight.sharedMount", "false") == "true":
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        tasks = max(2, spark.sparkContext.defaultParallelism)
        trial = f"{folder}/staged/{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(trial)
        if spark.read.schema("id BIGINT").parquet(trial).count() != tasks:
            raise RuntimeError(f"{folder} is on local disks that executors do not share; name a shared folder in spark.checkpoint.dir")
    _SEEN.add(key)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Used where several passes need the same intermediate: the upstream work runs
    once, later passes read only the columns they need, and a lost executor
    rereads files instead of replaying the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A small table (one row per key) written first, so that the planner knows its true size.

    A join then broadcasts it only when it fits the broadcast limit; beyond that both
    sides are shuffled and adaptive execution splits a hot key. Without this the planner
    would guess from the size of the large table and shuffle that one every time. The aggregate
    keeps its partitions; adaptive execution joins small ones.
    """
    return staged(df)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write a table once in as many buckets of the keys as shuffles have partitions.

    For a large table that small ones are joined to again and again: they are dealt out as the buckets are, the
    table itself stays where it is. It is in the session's catalogue until ``forget_bucketed``.
    """
    spark = df.sparkSession
    name = f"barlight_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
    writer.option("path", f"{shared_folder(spark)}/staged/{name}").saveAsTable(name)
    return spark.table(name)


def forget_bucketed(df: DataFrame) -> None:
    """Take a table written by ``bucketed`` out of the catalogue; nothing may read it any more."""
    for path in df.inputFiles():
        for part in path.split("/"):
            if part.startswith("barlight_") and df.sparkSession.catalog.tableExists(part):
                df.sparkSession.sql(f"DROP TABLE {part}")
                return
