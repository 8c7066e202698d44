"""Order-dependent operators: numbering, deltas, gaps, sweeps, folds. All go through ``Scanner``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.plans.slices import (
    Scanner,
    lag,
    last_value,
    lead,
    row_number,
    running_max,
    running_sum,
    scan,
)


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return epoch_us(ts) / 1e6


def number_rows(df: DataFrame, keys, order, prefix: str | None = None, out: str = "id") -> DataFrame:
    """Dense numbers from 1 in order, per key; with a prefix they become typed ids (s1, d1, c1 ...)."""
    numbered = scan(df, keys, order, {out: row_number()})
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.col(out).cast("string"))) if prefix else numbered


def delta_prev(df: DataFrame, keys, ts: str, tie: Sequence[str] = (), out: str = "delta_s") -> DataFrame:
    """Seconds since the previous row with a known time; null for the first and for unknown times."""
    known = F.when(F.col(ts).isNotNull(), epoch_us(F.col(ts)))
    res = scan(df, keys, [ts, *tie], {"_prev": last_value(known, inclusive=False)})
    return res.withColumn(out, (epoch_us(F.col(ts)) - F.col("_prev")) / 1e6).drop("_prev")


def gaps(df: DataFrame, keys, ts: str, min_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """Intervals longer than ``min_s`` between a row and the latest time before it.

    ``tie`` is the arrival order: a row that arrives late does not move the clock back.
    """
    order = list(tie) or [ts]
    us = epoch_us(F.col(ts))
    res = scan(df, keys, order, {"_clock": running_max(us, inclusive=False)})
    res = res.withColumn("gap_us", us - F.col("_clock")).where(F.col("gap_us") > int(min_s * 1e6))
    return res.withColumn("gap_ms", F.col("gap_us") / 1000.0).drop("_clock")


def longest_gap(df: DataFrame, keys, ts: str, min_s: float, tie: Sequence[str] = ()) -> DataFrame:
    return gaps(df, keys, ts, min_s, tie).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max("gap_us").alias("max_gap_us")
    )


def peak_concurrency(df: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Largest number of intervals open at once, and when it is first reached.

    An interval still counts at its end: the closing event is one microsecond later, and at equal
    times closings go first. Events at one time are summed before the sweep.
    """
    s = epoch_us(F.col(start))
    e = epoch_us(F.coalesce(F.col(end), F.col(start))) + 1
    events = df.select(
        *keys,
        F.explode(F.array(
            F.struct(s.alias("t"), F.lit(1).alias("d")), F.struct(e.alias("t"), F.lit(-1).alias("d"))
        )).alias("ev"),
    )
    steps = events.groupBy(*keys, F.col("ev.t").alias("t"), F.col("ev.d").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    swept = scan(steps, keys, ["t", "d"], {"open": running_sum(F.col("d") * F.col("n"))})
    return swept.groupBy(*keys).agg(
        F.max("open").cast("bigint").alias("peak"),
        F.timestamp_micros(F.min_by("t", F.struct(-F.col("open"), F.col("t")))).alias("peak_at"),
    )


def over_limit(df: DataFrame, keys, ts: str, window_s: int, max_hits: int, tie: Sequence[str]) -> DataFrame:
    """Rows that come when at least ``max_hits`` earlier rows of the key lie inside the window.

    A sliding count as a sweep: a row enters at its time and leaves ``window_s`` later, leaving first.
    """
    us = epoch_us(F.col(ts))
    enter = df.withColumn("_t", us).withColumn("_d", F.lit(1))
    leave = df.select(*keys, *tie, (us + int(window_s * 1e6)).alias("_t"), F.lit(-1).alias("_d"))
    both = enter.unionByName(leave, allowMissingColumns=True)
    swept = scan(both, keys, ["_t", "_d", *tie], {"hits_before": running_sum(F.col("_d"), inclusive=False)})
    hits = swept.where(F.col("_d") == 1).withColumn("hits_before", F.coalesce("hits_before", F.lit(0)).cast("bigint"))
    return hits.where(F.col("hits_before") >= max_hits).drop("_t", "_d")


def repeated(df: DataFrame, keys, value: str, at_least: int = 2) -> DataFrame:
    """Values seen ``at_least`` times per key, e.g. a nonce that loops."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("times"))
        .where(F.col("times") >= at_least)
    )


def series(df: DataFrame, keys, ts: str, value: Column, out: str = "value") -> DataFrame:
    """The time series of one measure, e.g. loss reports per source."""
    return df.select(*keys, ts, value.alias(out)).where(F.col(out).isNotNull()).orderBy(*keys, ts)


def pick(df: DataFrame, keys, order: Sequence[str], how: str = "first") -> DataFrame:
    """One whole row per key: the first or last in order, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = (F.min_by if how == "first" else F.max_by)(
        F.struct(*rest), F.struct(*[F.col(c) for c in order])
    )
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def sessionize(df: DataFrame, keys, ts: str, gap_s: int, tie: Sequence[str], out: str = "session_no") -> DataFrame:
    """Number the runs of rows per key whose steps are at most ``gap_s`` seconds."""
    s = Scanner(df, keys, [ts, *tie]).add(_prev=last_value(epoch_us(F.col(ts)), inclusive=False))
    fresh = F.col("_prev").isNull() | (epoch_us(F.col(ts)) - F.col("_prev") > int(gap_s * 1e6))
    s.with_column("_new", fresh.cast("bigint")).add(**{out: running_sum(F.col("_new"))})
    return s.df.drop("_prev", "_new")


def timeline(*dfs: DataFrame, keys, ts: str, order: Sequence[str], hidden: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """Rows of several kinds on one clock, hidden rows left out, with the time since the row before."""
    merged = dfs[0]
    for df in dfs[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    if hidden is not None:
        merged = merged.join(hidden.select(*keys, id_col), [*keys, id_col], "left_anti")
    return delta_prev(merged, keys, ts, order)


def ewma(df: DataFrame, keys, order, value: str, weight: float = 1 / 16, chunk: int = 512, out: str = "ewma") -> DataFrame:
    """j = j + (x - j) * weight over the rows of a key, starting from 0; rows with null x keep j.

    A linear recurrence: inside a chunk of ``chunk`` rows it is a decayed running sum, and a chunk
    hands its end value on. Ends of earlier chunks are taken in as long as their decay is above
    1e-18 of the value (two chunks for 1/16 and 512), so j is exact to a double. Chunks are cut by
    row number, so no window is longer than one chunk.
    """
    keep = 1.0 - weight
    s = Scanner(df, keys, order).add(_i=running_sum(F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint")))
    rows = (
        s.df.withColumn("_chunk", F.floor((F.col("_i") - 1) / chunk).cast("bigint"))
        .withColumn("_k", (F.pmod(F.col("_i") - 1, F.lit(chunk)) + 1).cast("double"))
        .withColumn("_x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * weight * F.pow(F.lit(1.0 / keep), F.col("_k")))
    )
    # rows before the first x have _i = 0, chunk -1 and a decayed sum of 0
    rows = Scanner(rows, [*keys, "_chunk"], order).add(_s=running_sum(F.when(F.col(value).isNotNull(), F.col("_x")).otherwise(0.0))).df
    rows = rows.withColumn("_local", F.col("_s") * F.pow(F.lit(keep), F.col("_k")))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by("_local", "_i").alias("_end"))
    reach = max(1, math.ceil(math.log(1e-18) / (chunk * math.log(keep))))
    s = Scanner(ends, keys, ["_chunk"])
    total, previous = F.lit(0.0), "_end"
    for i in range(1, reach + 1):
        s.add(**{f"_e{i}": lag(F.col(previous))})
        previous = f"_e{i}"
        total = total + keep ** (chunk * (i - 1)) * F.coalesce(previous, F.lit(0.0))
    carry = s.df.select(*keys, "_chunk", total.alias("_carry"))
    rows = rows.join(carry, [*keys, "_chunk"], "left")
    j = F.col("_local") + F.pow(F.lit(keep), F.col("_k")) * F.coalesce("_carry", F.lit(0.0))
    return rows.withColumn(out, F.when(F.col("_i") > 0, j).otherwise(0.0)).drop("_i", "_chunk", "_k", "_x", "_s", "_local", "_carry")


def fold_events(df: DataFrame, keys, order, identity: Sequence[str], duration: str, ended: str) -> DataFrame:
    """Runs of update packets to one event each: same identity and the packet before did not end it."""
    s = Scanner(df, keys, order)
    s.add(_same=lag(F.struct(*identity)), _ended=lag(F.col(ended)))
    fresh = ~F.col("_same").eqNullSafe(F.struct(*identity)) | F.coalesce("_ended", F.lit(True))
    s.with_column("_new", fresh.cast("bigint")).add(event_no=running_sum(F.col("_new")))
    return s.df.groupBy(*keys, "event_no", *identity).agg(
        F.min(order[0]).alias("ts"),
        F.max(duration).alias("duration_units"),
        F.max(F.col(ended).cast("int")).cast("boolean").alias("ended"),
    )


def next_value(df: DataFrame, keys, order, value: Column, out: str) -> DataFrame:
    return scan(df, keys, order, {out: lead(value)})
