"""Temperature mixing of sources under a token budget.

A source with token share s gets the weight s^a, normalised. The exponent a is bisected: towards a target entropy of
the weights, or to the flattest mixture in which no source is repeated more often than a limit. Weights become quotas of
the budget. A source's documents are dealt in permutations, one per epoch, by seeded hashes: whole epochs first, then the
last one up to the quota. A source's stream is cut at equal shares of its quota, the blocks of the mixture, so every block
holds each source by its weight; within a block documents stand in hashed order.

The running token counts are taken per (source, epoch, range of hashes) of bounded size, with the sums of earlier ranges
added, so one source may hold most rows.

Cases: a null source is a source of its own; null texts count no tokens, and documents without tokens are taken once per
epoch that reaches them; equal rows are dealt apart by a running number; no token at all: every row once, in block
0; one source: weight 1; an empty table gives an empty result; all input columns stay, clashing ones (``epoch``, ``block``,
``order_in_block``, ``tokens``) as ``<name>_in``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import set_aside
from sigspark.plans.slices import join_null_safe
from sigspark.session import BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT, int_conf, stage

OWN = ["tokens", "epoch", "block", "order_in_block"]
# Columns that stand beside the documents' own on the way.
INNER = ["_source", "source_tokens", "quota", "epochs", "_h", "_range", "_base", "_before", "_at"]
STEPS = 60
MAX_EXPONENT = 8.0
RANGE_ROWS = 10_000


def word_count(text: str) -> Column:
    """Words between white space, a stand-in for tokens that needs no vocabulary."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def bisect(fits: Callable[[float], bool], low: float, high: float) -> float:
    """The smallest number between ``low`` and ``high`` that fits, where all larger ones fit too."""
    if fits(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class Totals:
    """Sums over the sources that a candidate exponent is judged by."""

    entropy: Callable[[float], float]
    largest_repetition: Callable[[float], float]
    scale: Callable[[float], float]  # sum of s^a


def totals_of(shares: np.ndarray) -> Totals:
    def weights(a: float) -> np.ndarray:
        w = shares**a
        return w / w.sum()

    def entropy(a: float) -> float:
        w = weights(a)
        return float(-(w * np.log(w)).sum())

    def repetition(a: float) -> float:
        """Of the most repeated source, when the least repeated one is read exactly once."""
        r = weights(a) / shares
        return float(r.max() / r.min())

    return Totals(entropy, repetition, lambda a: float((shares**a).sum()))


def totals_by_job(sources: DataFrame) -> Totals:
    """The same from a table of shares of any length, by one small aggregation per candidate."""

    def entropy(a: float) -> float:
        p = F.pow("share", F.lit(a))
        z, plogp = sources.agg(F.sum(p), F.sum(p * F.log(p))).first()
        return math.log(z) - plogp / z

    def repetition(a: float) -> float:
        r = F.pow("share", F.lit(a - 1))
        high, low = sources.agg(F.max(r), F.min(r)).first()
        return high / low

    return Totals(entropy, repetition, lambda a: sources.agg(F.sum(F.pow("share", F.lit(a)))).first()[0])


def exponent(totals: Totals, entropy: float | None, repetition: float | None) -> float:
    """Largest exponent whose weights have at least the target ``entropy`` (nats), or smallest in [0, 1] within the ``repetition`` limit."""
    if entropy is not None:
        # entropy falls as the exponent grows
        return bisect(lambda a: totals.entropy(a) <= entropy, 0.0, MAX_EXPONENT)
    return bisect(lambda a: totals.largest_repetition(a) <= (repetition or 1.0), 0.0, 1.0)


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = 1.5, budget: int | None = None, source: str = "source") -> tuple[DataFrame, int]:
    """(per source: source, source_tokens, weight, quota, epochs; the budget). ``docs`` has ``tokens``.

    Without ``budget`` it is the least that reads every source once in full.
    """
    spark = docs.sparkSession
    sums = stage(docs.groupBy(F.col(source).alias("source")).agg(F.sum("tokens").alias("source_tokens")), "sources")
    n, total = sums.where("source_tokens > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("source_tokens"), F.lit(0))).first()
    if not total:
        return sums.select("source", "source_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).alias("epochs")), 0
    shares = sums.where("source_tokens > 0").select((F.col("source_tokens") / total).alias("share"))
    if n <= int_conf(spark, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT):
        found = totals_of(np.array([r[0] for r in shares.orderBy("share").collect()]))
    else:
        found = totals_by_job(shares)
    a = exponent(found, entropy, repetition)
    weight = F.pow(F.col("source_tokens") / total, F.lit(a)) / F.lit(found.scale(a))
    out = sums.withColumn("weight", F.when(F.col("source_tokens") > 0, weight).otherwise(0.0))
    if budget is None:
        budget = math.ceil(out.where("weight > 0").agg(F.max(F.col("source_tokens") / F.col("weight"))).first()[0] - 1e-6)
    # the source that sets the budget is read exactly once
    quota = F.round(F.col("weight") * budget).cast("long")
    epochs = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest("source_tokens", F.lit(1)))).cast("int")
    return stage(out.withColumn("quota", quota).withColumn("epochs", epochs), "weights"), budget


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = 1.5, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 5, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the mixture: input columns with tokens, epoch, block and order_in_block (sort by the last two)."""
    own = set_aside(docs, OWN)
    rows = set_aside(own, INNER)
    names = [F.col(f"`{a}`").alias(c) for a, c in zip(rows.columns, own.columns, strict=True)]
    rows = rows.withColumn("tokens", word_count(text))
    weights, budget = plan(rows, entropy, repetition, budget, source)
    blocks = max(1, math.ceil(budget / block_tokens))
    spark = docs.sparkSession
    known = weights.select(F.col("source").alias("_source"), "source_tokens", "quota", "epochs")
    if weights.count() <= int_conf(spark, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT):
        known = F.broadcast(known)
    told = rows.join(known, rows[source].eqNullSafe(known["_source"]))
    dealt = told.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", doc_id, text))
    # equal ranges of the hash, of about RANGE_ROWS rows in the largest source
    ranges = max(1, math.ceil((rows.groupBy(source).count().agg(F.max("count")).first()[0] or 0) / RANGE_ROWS))
    dealt = dealt.withColumn("_range", F.least(F.lit(ranges - 1), F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * ranges)).cast("int"))
    group = ["_source", "epoch", "_range"]
    sums = dealt.groupBy(*group).agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("_source", "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    # rows with equal hashes are equal in id and text: their order does not matter
    earlier = Window.partitionBy(*group).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    at = join_null_safe(local, base, group).withColumn("_at", F.col("epoch") * F.col("source_tokens") + F.col("_base") + F.col("_before"))
    taken = at.where((F.col("_at") < F.col("quota")) | ((F.col("tokens") == 0) & (F.col("_at") <= F.col("quota"))) | (F.col("source_tokens") == 0))
    block = F.least(F.lit(blocks - 1), F.floor(F.col("_at") * blocks / F.greatest("quota", F.lit(1)))).cast("int")
    order = F.xxhash64(F.lit(seed + 1), "_h", "epoch")
    return taken.withColumn("block", block).withColumn("order_in_block", order).select(*names, "tokens", "epoch", "block", "order_in_block")
