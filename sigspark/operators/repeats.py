"""Duplicate collapse, its classification, and bursts across many entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.ordered import epoch_us
from sigspark.plans.slices import Scanner, join_null_safe, last_value, lead, running_sum, scan


def collapse_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str, at_least: int = 2):
    """(collapses, members): groups of equal ``keys`` with at least two rows, and every later row's
    pointer to the first.

    Only aggregates that combine on the map side, so a group of copies of any size is cheap; the
    pointers come from a join of the rows with one row per group, which AQE splits when skewed.
    """
    at = F.struct(*[F.col(c) for c in order])
    groups = (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(order[0]).alias("first_ts"),
            F.max(order[0]).alias("last_ts"),
            F.min_by(row_id, at).alias("first_id"),
        )
        .where(F.col("count") >= at_least)
        .withColumn("span_us", epoch_us(F.col("last_ts")) - epoch_us(F.col("first_ts")))
    )
    members = join_null_safe(df, groups.select(*keys, "first_id"), keys, "inner")
    members = members.where(F.col(row_id) != F.col("first_id")).withColumnRenamed("first_id", "repeat_of")
    return groups, members


def message_repeats(leg_messages: DataFrame):
    """Retransmissions of a leg: equal branch, sequence, method or status, and identical bytes."""
    base = leg_messages.withColumn("kind", F.when(F.col("is_request"), "request").otherwise("response"))
    base = base.withColumn("what", F.when(F.col("is_request"), F.col("method")).otherwise(F.col("status").cast("string")))
    base = base.withColumn("cseq_num", F.col("cseq.num")).withColumn("cseq_method", F.col("cseq.method"))
    base = base.withColumn("raw_hash", F.sha2("raw", 256))
    keys = ["capture_id", "leg_id", "branch", "cseq_num", "cseq_method", "kind", "what", "raw_hash"]
    collapses, members = collapse_repeats(base, keys, ["ts", "ord"], "msg_id")
    first = base.select(
        F.col("capture_id"), F.col("msg_id").alias("first_id"), "size", "transport", "dst", "method", "status"
    )
    collapses = collapses.join(first, ["capture_id", "first_id"])
    second = members.groupBy("capture_id", F.col("repeat_of").alias("first_id")).agg(F.min("ts").alias("second_ts"))
    return collapses.join(second, ["capture_id", "first_id"], "left"), members.select("capture_id", "leg_id", "msg_id", "repeat_of", "ts")


def burst_buckets(df: DataFrame, ts: str, width: str, entity: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct entities per tumbling bucket; empty buckets do not appear."""
    return (
        df.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"))
        .select(*keys, F.col("w.start").alias("bucket_start"), "n_rows", "n_entities")
    )


def burst_windows(df: DataFrame, ts: str, width_s: float, entity: str, min_entities: int, keys: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Periods in which at least ``min_entities`` entities are active within ``width_s`` seconds.

    Every row whose look-back window holds enough entities marks that window; touching windows
    merge. The distinct count is a sweep: per entity, rows at most a window apart form one run,
    which enters at its start and leaves one window after its end. So no set is collected and the
    work is linear however many rows share a key.
    """
    keys = list(keys)
    width = int(width_s * 1e6)
    us = epoch_us(F.col(ts))
    rows = df.select(*keys, F.col(entity).alias("_e"), us.alias("_t"), *tie)
    runs = Scanner(rows, [*keys, "_e"], ["_t", *tie]).add(
        _p=last_value(F.col("_t"), inclusive=False), _n=lead(F.col("_t"))
    ).df
    enter = runs.where(F.col("_p").isNull() | (F.col("_t") - F.col("_p") > width)).select(
        *keys, "_t", F.lit(0).alias("_o"), F.lit(1).alias("_d")
    )
    leave = runs.where(F.col("_n").isNull() | (F.col("_n") - F.col("_t") > width)).select(
        *keys, (F.col("_t") + width).alias("_t"), F.lit(2).alias("_o"), F.lit(-1).alias("_d")
    )
    steps = enter.unionByName(leave).groupBy(*keys, "_t", "_o").agg(F.sum("_d").alias("_d"))
    times = rows.groupBy(*keys, "_t").agg(F.lit(1).alias("_o"), F.lit(0).cast("bigint").alias("_d"))
    sweep = steps.unionByName(times)
    # keys may be empty: the capture is then one group, which Scanner slices when it is large
    part = keys or ["_all"]
    if not keys:
        sweep = sweep.withColumn("_all", F.lit(0))
    swept = scan(sweep, part, ["_t", "_o"], {"_open": running_sum(F.col("_d"))}).where(F.col("_o") == 1)
    s = Scanner(swept.drop("_d", "_o"), part, ["_t"])
    hit = F.col("_open") >= min_entities
    s.add(_pq=last_value(F.when(hit, F.col("_t")), inclusive=False))
    s.with_column("_new", (hit & (F.col("_pq").isNull() | (F.col("_t") - F.col("_pq") > width))).cast("bigint"))
    s.add(_isle=running_sum(F.col("_new")))
    s.with_column("_q", F.when(hit, F.struct(F.col("_t").alias("t"), F.col("_isle").alias("i"))))
    s.add(_nq=last_value(F.col("_q"), reverse=True))
    marked = s.df.where(F.col("_nq").isNotNull() & (F.col("_nq.t") - F.col("_t") <= width))
    marked = marked.select(*part, "_t", F.col("_nq.i").alias("window_no"))
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    inside = join_null_safe(rows, marked, [*part, "_t"], "inner")
    out = inside.groupBy(*part, "window_no").agg(
        F.timestamp_micros(F.min("_t")).alias("start_ts"),
        F.timestamp_micros(F.max("_t")).alias("end_ts"),
        F.countDistinct("_e").alias("n_entities"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return out.drop("_all")


def classify_repeats(collapses: DataFrame, responses: DataFrame, storms: DataFrame | None = None, acks: DataFrame | None = None, late_after_s: float = 1.0, max_udp: int = 1300, abandon_s: float = 28.0) -> DataFrame:
    """Outcome and likely cause of each repeat group.

    ``responses``: capture_id, leg_id, cseq_num, cseq_method, first_response_ts per request.
    ``acks``: capture_id, leg_id, cseq_num, ack_ts. ``storms``: capture_id, start_ts, end_ts.
    Causes are tried in a fixed order: storm, fragmentation, never arrived, name lookup that blocks,
    slow far end, lost acknowledgement, unknown.
    """
    req = ["capture_id", "leg_id", "cseq_num", "cseq_method"]
    out = collapses.join(responses.select(*req, "first_response_ts"), req, "left")
    ack_key = ["capture_id", "leg_id", "cseq_num"]
    if acks is None:
        out = out.withColumn("ack_ts", F.lit(None).cast("timestamp"))
    else:
        out = out.join(acks.select(*ack_key, "ack_ts"), ack_key, "left")
    is_request = F.col("kind") == "request"
    unanswered = is_request & F.col("first_response_ts").isNull()
    delay_us = epoch_us(F.col("first_response_ts")) - epoch_us(F.col("first_ts"))
    late = is_request & F.col("first_response_ts").isNotNull() & (F.col("first_response_ts") >= F.coalesce("second_ts", "last_ts"))
    out = out.withColumn("_late", F.coalesce(late, F.lit(False))).withColumn("_delay_us", delay_us)
    out = out.join(_alike(out.where("_late"), late_after_s), ["capture_id", "dst", "leg_id"], "left")
    if storms is None:
        out = out.withColumn("_storm", F.lit(False))
    else:
        in_storm = _inside(out, storms)
        out = out.join(in_storm.withColumn("_storm", F.lit(True)), ["capture_id", "first_id"], "left")
    storm = F.coalesce("_storm", F.lit(False))
    ok_repeat = ~is_request & F.col("status").between(200, 299)
    ack_lost = ok_repeat & (F.col("ack_ts").isNull() | (F.col("ack_ts") > F.col("second_ts")))
    udp = F.lower(F.coalesce("transport", F.lit("udp"))) == "udp"
    code = (
        F.when(storm, "box-wide-storm")
        .when(unanswered & udp & (F.col("size") > max_udp), "udp-fragmentation")
        .when(unanswered, "never-arrived")
        .when(F.col("_late") & (F.col("_alike") >= 2) & (F.col("_delay_us") >= int(late_after_s * 1e6)), "dns-blocking")
        .when(F.col("_late"), "slow-far-end")
        .when(ack_lost, "ack-not-landing")
        .otherwise("unknown")
    )
    outcome = (
        F.when(unanswered & (F.col("span_us") >= int(abandon_s * 1e6)), "abandoned")
        .when(unanswered, "no-response")
        .when(F.col("_late"), "late-response")
        .when(ok_repeat & F.col("ack_ts").isNotNull(), "eventually-acked")
        .when(ok_repeat, "no-response")
        .otherwise("resolved")
    )
    severity = F.when(code.isin("never-arrived", "udp-fragmentation", "ack-not-landing", "box-wide-storm"), "crit").when(
        code.isin("slow-far-end", "dns-blocking"), "warn"
    ).otherwise("info")
    label = F.concat(
        F.coalesce(F.when(is_request, F.col("method")), F.col("status").cast("string")),
        F.lit(" x"), F.col("count").cast("string"), F.lit(", "), outcome,
    )
    return (
        out.withColumn("code", code)
        .withColumn("outcome", outcome)
        .withColumn("severity", severity)
        .withColumn("label", label)
        .withColumn("delay_s", F.col("_delay_us") / 1e6)
        .drop("_late", "_delay_us", "_alike", "_storm")
    )


def _alike(late: DataFrame, late_after_s: float, spread_s: float = 0.25) -> DataFrame:
    """Per late leg the number of legs to its destination delayed alike: the sign of a name lookup
    that holds up every request. Delays are put on a clock and counted by a scan."""
    from sigspark.operators.pairing import near_in_time

    legs = late.where(F.col("_delay_us") >= int(late_after_s * 1e6)).groupBy("capture_id", "dst", "leg_id").agg(
        F.timestamp_micros(F.min("_delay_us")).alias("at")
    )
    near = near_in_time(legs, legs, spread_s, ["capture_id", "dst"], "at", "at", "leg_id", "leg_id")
    return near.select("capture_id", "dst", "leg_id", F.col("n_near").alias("_alike"))


def _inside(collapses: DataFrame, storms: DataFrame) -> DataFrame:
    """Ids of collapses whose first repeat lies in a storm: storms are disjoint, so the last storm that
    starts before it decides; found by a scan over both, not by a range join."""
    a = collapses.select("capture_id", epoch_us(F.col("second_ts")).alias("_t"), F.lit(1).alias("_o"), "first_id", F.lit(None).cast("bigint").alias("_end"))
    b = storms.select("capture_id", epoch_us(F.col("start_ts")).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast("string").alias("first_id"), epoch_us(F.col("end_ts")).alias("_end"))
    both = scan(a.unionByName(b), ["capture_id"], ["_t", "_o", "first_id"], {"_until": last_value(F.col("_end"))})
    return both.where((F.col("_o") == 1) & (F.col("_until") >= F.col("_t"))).select("capture_id", "first_id")


def retransmission_report(leg_messages: DataFrame, width_s: float = 2.0, min_legs: int = 3) -> dict[str, DataFrame]:
    """Collapses with causes, repeat pointers, one-second buckets and storm windows of a capture set."""
    collapses, members = message_repeats(leg_messages)
    cseq = leg_messages.select("capture_id", "leg_id", "ts", "is_request", "status", "method", F.col("cseq.num").alias("cseq_num"), F.col("cseq.method").alias("cseq_method"))
    responses = cseq.where(~F.col("is_request")).groupBy("capture_id", "leg_id", "cseq_num", "cseq_method").agg(F.min("ts").alias("first_response_ts"))
    acks = cseq.where(F.col("is_request") & (F.col("method") == "ACK")).groupBy("capture_id", "leg_id", "cseq_num").agg(F.min("ts").alias("ack_ts"))
    storms = burst_windows(members, "ts", width_s, "leg_id", min_legs, ["capture_id"], ["msg_id"])
    return {
        "collapses": classify_repeats(collapses, responses, storms, acks),
        "repeats": members,
        "burst_buckets": burst_buckets(members, "ts", "1 second", "leg_id", ["capture_id"]),
        "burst_windows": storms,
    }


def collapse_groups(classified: DataFrame) -> DataFrame:
    """Groups of causes per destination with the worst sample kept."""
    return classified.groupBy("capture_id", "code", "what", "dst").agg(
        F.count(F.lit(1)).alias("n_collapses"),
        F.countDistinct("leg_id").alias("n_legs"),
        F.sum("count").alias("n_copies"),
        F.max_by("label", F.struct("count", "span_us", "first_id")).alias("worst_label"),
        F.max_by("leg_id", F.struct("count", "span_us", "first_id")).alias("worst_leg"),
    )
