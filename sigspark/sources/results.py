"""Sinks: result tables, catalogue, subject export and erasure, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.rollups import SEVERITIES, count_by, retention_plan


def write_results(tables: dict[str, DataFrame], folder: str, partition_by: Sequence[str] = ("capture_id",), mode: str = "overwrite") -> None:
    """Each table as parquet partitioned by capture; only the partitions written are replaced.

    Rows are brought together by capture; adaptive execution splits a large capture over as many tasks as its size asks for.
    """
    for name, df in tables.items():
        spread = df.hint("rebalance", *partition_by) if partition_by else df
        writer = spread.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/{name}")


def capture_meta(stats: DataFrame, findings: DataFrame, uploaded_at: Column) -> DataFrame:
    """Metadata per capture with finding counts by severity."""
    counts = count_by(findings, ["capture_id"], "severity", SEVERITIES)
    out = stats.join(counts, "capture_id", "left").withColumn("uploaded_at", uploaded_at)
    for s in SEVERITIES:
        out = out.withColumn(s, F.coalesce(s, F.lit(0)))
    return out


def catalogue(meta: DataFrame) -> DataFrame:
    """Captures newest first; without an upload time the time of the file counts."""
    return meta.withColumn("sort_ts", F.coalesce("uploaded_at", "modified_at")).orderBy(F.col("sort_ts").desc_nulls_last(), "capture_id")


def export_subject(tables: dict[str, DataFrame], key: str, value: str) -> dict[str, DataFrame]:
    """The rows of one account in every table that knows accounts."""
    return {n: df.where(F.col(key) == value) for n, df in tables.items() if key in df.columns}


def write_export(rows: dict[str, DataFrame], folder: str) -> None:
    for name, df in rows.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def erase_subject(tables: dict[str, DataFrame], key: str, value: str) -> dict[str, DataFrame]:
    """The tables without the rows of one account; rows of unknown account stay."""
    return {n: df.where(~F.col(key).eqNullSafe(value)) if key in df.columns else df for n, df in tables.items()}


def anonymise_subject(df: DataFrame, key: str, value: str, blank: Sequence[str]) -> DataFrame:
    """Rows of one account keep their content and lose who wrote them."""
    mine = F.col(key).eqNullSafe(value)
    out = df.withColumn("_mine", mine)
    for c in blank:
        out = out.withColumn(c, F.when(F.col("_mine"), F.lit("").cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out.drop("_mine")


# What a feedback record may carry of its context.
ALLOWED_CONTEXT = ["page", "scenario", "counts", "scope_type", "method", "app_version"]


def scrub_context(df: DataFrame, context: str = "context", allowed: Sequence[str] = ALLOWED_CONTEXT) -> DataFrame:
    """Keep the permitted fields of a context struct and nothing else."""
    have = [f for f in allowed if f in df.schema[context].dataType.fieldNames()]
    return df.withColumn(context, F.struct(*[F.col(context)[f].alias(f) for f in have]))


def apply_retention(spark: SparkSession, tables: dict[str, DataFrame], meta: DataFrame, days: int, now: Column, dry: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, tables after the sweep). A dry run reports and leaves the tables as they are."""
    plan = retention_plan(meta, days, now)
    report = plan.groupBy("fate").agg(F.count(F.lit(1)).alias("n"))
    if dry or days <= 0:
        return report, tables
    gone = plan.where(F.col("fate") == "remove").select("capture_id")
    return report, {n: df.join(gone, "capture_id", "left_anti") for n, df in tables.items()}
