"""Small helpers shared by the corpus operators: clashing names, shared folders, files."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import stage_dir

ARROW_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1_000


def set_aside(df: DataFrame, reserved: list[str]) -> DataFrame:
    """``df`` with columns that clash with ``reserved`` names renamed to ``<name>_in`` (``_in_in`` and so on)."""
    taken = {c.lower() for c in [*df.columns, *reserved]}
    out = df
    for c in df.columns:
        if c.lower() in {r.lower() for r in reserved}:
            new = c + "_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            out = out.withColumnRenamed(c, new)
    return out


def named_back(df: DataFrame, like: DataFrame, reserved: list[str]) -> DataFrame:
    """The columns of ``like`` alone, those that ``set_aside`` renamed in ``df`` under their own names."""
    aside = set_aside(like, reserved).columns
    tick = lambda c: "`" + c.replace("`", "``") + "`"
    return df.select(*(F.col(tick(a)).alias(c) for a, c in zip(aside, like.columns, strict=True)))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share (``spark.checkpoint.dir``)."""
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder address and the path within it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def text_batches(spark: SparkSession) -> None:
    """Has the session hand Python at most TEXT_ROWS rows at once; a smaller number set by the caller stays.

    Spark's 10,000 rows of whole texts are a batch of tens of MB, held several times over by a task and its Python worker.
    """
    now = int(spark.conf.get(ARROW_ROWS_CONF))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(ARROW_ROWS_CONF, str(TEXT_ROWS))


# What a Python worker keeps for tasks to come. Workers serve tasks of all kinds, and those of another kind clear it first.
WORKER_HELD: dict = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all else untouched. Texts of ASCII alone take the fast way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
