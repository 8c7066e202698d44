"""Which of many possible pieces are real, when each real piece says where the next may begin."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.plans.slices import Scan, Scanner, lead, row_number, running_max, running_sum
from sigspark.session import stage


def lead_present(expr) -> Scan:
    """The next value after this row that is not null."""
    return Scan("last", expr, inclusive=False, reverse=True)


def reached(pieces: DataFrame, keys: Sequence[str], at: str, until: str, anywhere: str | None = None, known_max: int | None = None) -> DataFrame:
    """The rows met when every key is walked from its first piece, always to the first piece at or after the end of the one before.

    ``at`` is unique within a key, ``until`` (above ``at``) is where a piece ends; null: nothing can follow it. With ``anywhere`` (a boolean column), rows where
    it is false are met only if the piece before ends exactly there, and not first in their key unless at 0.

    No key is walked in order. A piece that begins at or after the end of all earlier ones is met whatever happened before; these
    points cut a key into blocks, and nearly all blocks hold one piece. In the others every piece points to its successor, and
    pointers are doubled, so a block of n pieces takes log n rounds of equi-joins. ``pieces`` is read several times: give a written table.
    """
    keys = list(keys)
    free = F.col(anywhere) if anywhere else F.lit(True)
    end = F.coalesce(F.col(until).cast("bigint"), F.lit(2**62))
    base = pieces.withColumn("_at", F.col(at).cast("bigint")).withColumn("_end", end).withColumn("_free", free)
    begins = F.col("_free") | (F.col("_at") == 0)
    s = Scanner(base, keys, ["_at"], known_max=known_max).add(_far=running_max(F.col("_end"), inclusive=False), _nth=running_sum(begins.cast("bigint")))
    s.with_column("_fresh", begins & ((F.col("_nth") == 1) | (F.col("_at") >= F.col("_far"))))
    s.add(_block=running_sum(F.col("_fresh").cast("bigint")), _next=lead(F.col("_fresh")))
    rows = s.df.where(F.col("_block") > 0)
    # one piece by itself needs no pointers
    single = F.col("_fresh") & F.coalesce("_next", F.lit(True))
    own = pieces.columns
    crowded = stage(rows.where(~single).drop("_far", "_nth", "_next"), "pieces")
    block = [*keys, "_block"]
    most = crowded.groupBy(*block).count().agg(F.max("count")).first()[0]
    if most is None:
        return rows.where(single).select(*own)
    numbered = Scanner(crowded, block, ["_at"], known_max=most).add(_n=row_number()).df
    # the successor: a free piece at or after the end, or any piece exactly there
    places = numbered.select(*block, F.col("_at").alias("_spot"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_from"), F.col("_n"), "_free")
    ends = numbered.select(*block, F.col("_end").alias("_spot"), F.lit(0).alias("_kind"), F.col("_n").alias("_from"), F.lit(None).cast("bigint").alias("_n"), F.lit(False).alias("_free"))
    look = Scanner(places.unionByName(ends), block, ["_spot", "_kind", "_from"], known_max=2 * most)
    mine = F.col("_kind") == 1
    look.add(_any=lead_present(F.when(mine, F.struct("_spot", "_n"))), _open=lead_present(F.when(mine & F.col("_free"), F.col("_n"))))
    after = F.when(F.col("_any._spot") == F.col("_spot"), F.col("_any._n")).otherwise(F.col("_open"))
    jumps = stage(look.df.where("_kind = 0").select(*block, F.col("_from").alias("_n"), after.alias("_to")).where(F.col("_to").isNotNull()), "pointers")
    met = numbered.where(F.col("_n") == 1).select(*block, "_n")
    for _ in range(max(1, math.ceil(math.log2(most)))):
        met = stage(met.unionByName(met.join(jumps, [*block, "_n"]).select(*block, F.col("_to").alias("_n"))).distinct(), "met")
        further = jumps.select(*block, F.col("_n").alias("_to"), F.col("_to").alias("_then"))
        jumps = stage(jumps.join(further, [*block, "_to"]).select(*block, "_n", F.col("_then").alias("_to")), "pointers")
    walked = numbered.join(met, [*block, "_n"], "left_semi")
    return rows.where(single).select(*own).unionByName(walked.select(*own))
