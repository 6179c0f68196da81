"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Line items behind one shuffle partition, partitions at most, and compressed bytes that a task reads, of a shuffle or a file
ROWS_PER_PARTITION, MAXIMUM_PARTITIONS, PARTITION_BYTES = 100_000, 4_000, "16m"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: UTC timestamps and adaptive plans."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: str = "8", app: str = "slatewise") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.sql.session.timeZone", "UTC")
        # per-game arrays and percentiles stay small; hash them instead of sorting after 128 games
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Starts shuffles with partitions in proportion to the input, so a task's share does not grow with it.

    Adaptive plans put small partitions together again; never fewer than the session asks for.  Scans are cut alike, so
    the groups that a task folds before a shuffle are bounded, too.
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAXIMUM_PARTITIONS, -(-rows // ROWS_PER_PARTITION)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", PARTITION_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may go without:
    a scratch folder is then made and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame, label: str):
    """Write a table to the shared folder and read it back: the lineage ends there, executors may be lost."""
    spark = frame.sparkSession
    path = work_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
