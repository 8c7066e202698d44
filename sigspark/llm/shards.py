"""Two-pass external shuffle into shards.

Pass 1 scatters whole records by seeded hashes: doc_id alone decides the shard, by the highest of one hash per shard
(so one more shard takes rows only into itself); doc_id and text decide which of the shard's memory-sized buckets.
Pass 2 holds one bucket at a time, puts it into a fixed order, Fisher-Yates shuffles it with a generator
seeded by its number, and writes it. A record's slot is the rows of its shard's earlier buckets plus its place.

Cases: null text has size 1 (no bytes plus 1) and no checksum; null doc_ids share a shard; equal rows each get a slot, and
a row repeated very often is spread over buckets by a running number; an empty table gives an empty result; every
input column is written, a clashing one (``shard``, ``bucket``, ``place``, ...) as ``<name>_in``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sigspark.llm.common import partitions, set_aside

# Bytes of records that one task holds to shuffle them.
BUCKET_BYTES = 24_000_000
# Rows with one and the same hash above which they are dealt out by a running number.
REPEATED_ROWS = 50_000
OWN = ["shard", "bucket", "place", "slot"]


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the id is highest; ties to the smaller number."""
    scores = F.array(*[F.xxhash64(F.lit(seed), F.lit(i), doc_id) for i in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0 to n-1: from the end, each place swaps with one at or before it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)) if n > 1 else [], strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def write(docs: DataFrame, folder: str, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> StructType:
    """Write all records of ``docs`` shuffled under ``folder``/shard=N; returns the schema to ``read`` them with."""
    spark = docs.sparkSession
    docs = set_aside(docs, OWN)
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    total = docs.agg(F.sum(record_size(text))).first()[0] or 0
    per_shard = max(1, math.ceil(max(total / bucket_bytes, partitions(spark)) / shards))
    # rows repeated beyond any bucket: counted with a combine before the shuffle; at most rows / REPEATED_ROWS of them
    repeated = [r[0] for r in docs.groupBy(h.alias("h")).count().where(F.col("count") > REPEATED_ROWS).select("h").toLocalIterator()]
    running = F.when(h.isin(repeated), F.monotonically_increasing_id()).otherwise(F.lit(0)) if repeated else F.lit(0)
    keyed = docs.withColumn("shard", shard_of(F.col(doc_id), shards, seed))
    keyed = keyed.withColumn("bucket", F.col("shard") + shards * F.pmod(F.xxhash64(F.lit(seed + 1), h, running), F.lit(per_shard)).cast("int"))

    def shuffle(table: pa.Table) -> pa.Table:
        fixed = table.sort_by([(doc_id, "ascending"), (text, "ascending")])
        order = fisher_yates(len(fixed), seed * 1_000_003 + fixed["bucket"][0].as_py())
        out = fixed.take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(len(out)), pa.int32()))

    schema = StructType([*keyed.schema.fields, StructField("place", IntegerType())])
    keyed.groupBy("bucket").applyInArrow(shuffle, schema).write.partitionBy("shard").parquet(folder)
    return schema


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The written records with ``shard`` and ``slot`` (gapless from 0 within the shard)."""
    rows = spark.read.schema(schema).parquet(folder)
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, as many as bytes / bucket_bytes
    base = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(base, ["shard", "bucket"])
    return out.withColumn("slot", F.col("_base") + F.col("place")).drop("_base", "bucket", "place")
