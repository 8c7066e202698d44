"""Session settings, table loading, and cutting lineage by a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Rows of one key that a single task may sort; keys above it are sliced (plans/slices.py).
GROUP_ROWS_CONF = "spark.sigspark.maxGroupRows"
GROUP_ROWS_DEFAULT = 2_000_000
# A side is broadcast only when its row count was bounded or counted below this.
BROADCAST_ROWS_CONF = "spark.sigspark.maxBroadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000


def build_session(master: str | None = None, app: str = "sigspark", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings given by the caller win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """The rows of a file scan over all cores, when the files are so few that some cores would stay idle.

    For work that is heavy per row, such as cutting texts; only for scans, whose partitions are known without running them.
    Rows are dealt by ``keys`` where given, which takes no memory; else in turn, for which a task sorts its rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir, as the cluster set it.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sigspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs and survives the loss of executors. The plan runs a
    single time (``checkpoint()`` runs it twice unless it is cached first).
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
