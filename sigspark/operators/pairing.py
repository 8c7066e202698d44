"""Request/response pairing, nearest-in-time and as-of lookups. All linear: no pair is enumerated."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.ordered import epoch_us
from sigspark.plans.slices import Scanner, last_value, row_number, running_min, running_sum
from sigspark.session import stage


def pair_fifo(df: DataFrame, keys: Sequence[str], is_request: Column, ts: str, row_id: str, tie: Sequence[str] = (), slow_s: float = 1.0, capture_end: DataFrame | None = None):
    """First in, first out: (exchanges, orphans). A response takes the oldest open request of its key.

    With S the running count of requests minus responses, a response finds nothing exactly when S
    falls below both 0 and its earlier minimum. Those orphans aside, the k-th response answers the
    k-th request, so the pairing is an equi-join on (key, k), which no hot key can skew.
    """
    keys, order = list(keys), [ts, *(tie or [row_id])]
    base = df.withColumn("_rq", is_request)
    step = F.when(F.col("_rq"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    s = Scanner(base, keys, order).add(_s=running_sum(step))
    s.add(_low=running_min(F.col("_s"), inclusive=False))
    s.with_column("_orphan", ~F.col("_rq") & (F.col("_s") < F.least(F.lit(0), F.coalesce("_low", F.lit(0)))))
    s.add(
        _kq=running_sum(F.col("_rq").cast("bigint")),
        _kr=running_sum((~F.col("_rq") & ~F.col("_orphan")).cast("bigint")),
    )
    rows = s.df
    rest = [c for c in df.columns if c not in keys]
    requests = rows.where("_rq").select(*keys, F.col("_kq").alias("_k"), *[F.col(c).alias("request_" + c) for c in rest])
    responses = rows.where(~F.col("_rq") & ~F.col("_orphan")).select(
        *keys, F.col("_kr").alias("_k"), *[F.col(c).alias("response_" + c) for c in rest]
    )
    out = requests.join(responses, [*keys, "_k"], "left").drop("_k")
    orphans = rows.where("_orphan").select(*df.columns)
    return _latency(out, ts, slow_s, capture_end, keys), orphans


def _latency(out: DataFrame, ts: str, slow_s: float, capture_end: DataFrame | None, keys) -> DataFrame:
    q, r = epoch_us(F.col("request_" + ts)), epoch_us(F.col("response_" + ts))
    out = out.withColumn("latency_us", F.when(r.isNotNull(), F.greatest(F.lit(0), r - q)))
    out = out.withColumn("slow", F.coalesce(F.col("latency_us") > int(slow_s * 1e6), F.lit(False)))
    out = out.withColumn("timed_out", F.col("response_" + ts).isNull())
    if capture_end is not None:
        scope = [c for c in capture_end.columns if c != "capture_end"]
        out = out.join(capture_end, scope, "left")
        waited = epoch_us(F.col("capture_end")) - q
        out = out.withColumn("waited_us", F.when(F.col("timed_out") & (waited > 0), waited)).drop("capture_end")
    return out


def pair_named(df: DataFrame, keys: Sequence[str], is_request: Column, ts: str, row_id: str, name: str, tie: Sequence[str] = (), slow_s: float = 1.0, capture_end: DataFrame | None = None):
    """FIFO pairing that prefers an open request of the same name: (exchanges, orphans).

    A response takes the oldest open request of its name, else the oldest of any; a null name fits any name. Whatever the
    names, the number of open requests follows from the rows' kinds alone, so a key is cut wherever it falls to 0: nothing is
    open there, and each busy period is paired by itself. A busy period in which every response finds a request of its own
    name is paired per (key, period, name) by position; only the others are replayed in order, streaming through sorted
    partitions with the open requests in memory. Rows are told apart by their place in the key, so equal rows stay two rows.
    """
    keys = list(keys)
    order = [ts, *(tie or [row_id])]
    low = df.withColumn("_name", F.lower(F.regexp_replace(F.col(name), r"\.$", ""))).withColumn("_rq", is_request)
    step = F.when(F.col("_rq"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    s = Scanner(low, keys, order).add(_s=running_sum(step), _n=row_number())
    s.add(_least=running_min(F.col("_s")))
    s.with_column("_idle", (F.col("_s") <= F.least(F.lit(0), F.col("_least"))).cast("bigint"))
    s.add(_busy=running_sum(F.col("_idle"), inclusive=False))
    low = stage(s.df.withColumn("_busy", F.coalesce("_busy", F.lit(0))).drop("_s", "_least", "_idle"), "busy-periods")
    period, extra = [*keys, "_busy"], ["_name", "_rq", "_n"]
    by_name, orphans = pair_fifo(low.where(F.col("_name").isNotNull()), [*period, "_name"], F.col("_rq"), ts, row_id, ["_n"], slow_s)
    # a period needs the replay when one of its responses found no request of its name, or has no name
    mixed = low.groupBy(*period).agg(F.countDistinct("_name").alias("_names"), F.max(F.col("_name").isNull().cast("int")).alias("_null"))
    stray = orphans.select(*period).distinct().withColumn("_stray", F.lit(1))
    replay = stage(mixed.join(stray, period, "left").where(((F.col("_stray") == 1) & (F.col("_names") > 1)) | (F.col("_null") == 1)).select(*period), "mixed-periods")
    settled = by_name.join(replay, period, "left_anti").withColumnRenamed("response__n", "_rid").drop("_name", "request__rq", "response__rq", "request__n")
    again = low.join(replay, period, "left_semi")
    pairs = _replay(again, period)
    rest = [c for c in df.columns if c not in keys]
    q = again.where("_rq").select(*period, F.col("_n").alias("_qid"), *[F.col(c).alias("request_" + c) for c in rest])
    r = again.where(~F.col("_rq")).select(*period, F.col("_n").alias("_rid"), *[F.col(c).alias("response_" + c) for c in rest])
    replayed = q.join(pairs, [*period, "_qid"], "left").join(r, [*period, "_rid"], "left").drop("_qid")
    out = settled.unionByName(_latency(replayed, ts, slow_s, None, keys))
    answered = out.where(F.col("_rid").isNotNull()).select(*period, F.col("_rid").alias("_n"))
    left_over = low.where(~F.col("_rq")).join(answered, [*period, "_n"], "left_anti").drop("_busy", *extra)
    out = out.drop("_busy", "_rid")
    if capture_end is not None:
        out = _latency(out.drop("latency_us", "slow", "timed_out"), ts, slow_s, capture_end, keys)
    return out, left_over


class OpenRequests:
    """Requests that wait, by arrival and by name; every request is put in and taken out once."""

    def __init__(self):
        self.waiting: dict[int, object] = {}
        self.by_name: dict[object, deque] = {}

    def put(self, number: int, name) -> None:
        self.waiting[number] = name
        self.by_name.setdefault(name, deque()).append(number)

    def _oldest(self, name):
        line = self.by_name.get(name)
        while line and line[0] not in self.waiting:
            line.popleft()
        return line[0] if line else None

    def take(self, name):
        """The number of the request answered, None if none is open."""
        if not self.waiting:
            return None
        fits = [] if name is None else [n for n in (self._oldest(name), self._oldest(None)) if n is not None]
        hit = min(fits) if fits else next(iter(self.waiting))
        del self.waiting[hit]
        return hit


def _replay(df: DataFrame, period: list[str]) -> DataFrame:
    """(period, _qid, _rid) of busy periods replayed in order; the state is the open requests of one period."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k]}" for k in period] + ["_qid bigint, _rid bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ones = None, OpenRequests()
        for batch in batches:
            row, asked, answer = [], [], []
            columns = [batch.column(c).to_pylist() for c in (*period, "_n", "_name", "_rq")]
            for i, (*key, n, name, rq) in enumerate(zip(*columns, strict=True)):
                if key != current:
                    current, open_ones = key, OpenRequests()
                if rq:
                    open_ones.put(n, name)
                elif (hit := open_ones.take(name)) is not None:
                    row.append(i)
                    asked.append(hit)
                    answer.append(n)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in period), pa.array(asked, pa.int64()), pa.array(answer, pa.int64())], names=[*period, "_qid", "_rid"])

    ordered = df.select(*period, "_n", "_name", "_rq").repartition(*[F.col(k) for k in period]).sortWithinPartitions(*period, "_n")
    return ordered.mapInArrow(run, schema)


def pair_by_id(df: DataFrame, keys: Sequence[str], is_request: Column, ts: str, row_id: str) -> DataFrame:
    """Requests with the first response of the same transaction id, and its round trip.

    ``keys`` end with the transaction id; only its first request counts.
    """
    keys = list(keys)
    at = F.struct(ts, row_id)
    rest = [c for c in df.columns if c not in keys]
    flagged = df.withColumn("_rq", is_request)
    first = flagged.groupBy(*keys, "_rq").agg(F.min_by(F.struct(*rest), at).alias("_row"), F.count(F.lit(1)).alias("_n"))
    q = first.where("_rq").select(*keys, *[F.col("_row")[c].alias("request_" + c) for c in rest], F.col("_n").alias("n_requests"))
    r = first.where(~F.col("_rq")).select(*keys, *[F.col("_row")[c].alias("response_" + c) for c in rest], F.col("_n").alias("n_responses"))
    out = q.join(r, keys, "left")
    rtt = epoch_us(F.col("response_" + ts)) - epoch_us(F.col("request_" + ts))
    rtt = F.when(rtt.isNotNull(), F.greatest(F.lit(0), rtt))
    return out.withColumn("rtt_us", rtt).withColumn("n_responses", F.coalesce("n_responses", F.lit(0)))


def round_trip(blocks: DataFrame, reports: DataFrame, max_s: float = 10.0) -> DataFrame:
    """Round trip of report blocks: arrival minus the named sender report minus the delay held.

    ``blocks``: capture_id, ts, block_ssrc, lsr, dlsr. ``reports``: capture_id, ts, sender_ssrc, ntp_mid.
    The latest report before the block carries the id when it was sent twice.
    """
    b = blocks.where(F.col("lsr") != 0)
    r = reports.select("capture_id", F.col("sender_ssrc").alias("block_ssrc"), F.col("ntp_mid").alias("lsr"), F.col("ts").alias("sent_at"))
    r = r.groupBy("capture_id", "block_ssrc", "lsr").agg(F.max("sent_at").alias("sent_at"))
    out = b.join(r, ["capture_id", "block_ssrc", "lsr"])
    ms = (epoch_us(F.col("ts")) - epoch_us(F.col("sent_at"))) / 1000.0 - F.round(F.col("dlsr") / 65536.0 * 1000.0, 3)
    return out.withColumn("rtt_ms", F.when((ms >= 0) & (ms < max_s * 1000), F.round(ms, 3)))


def asof_next(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, left_id: str, right_id: str, strict: bool = False) -> DataFrame:
    """For each left row the first right row at or after it: (keys, left_id, left_ts, next_id, next_ts)."""
    return _asof(left, right, keys, left_ts, right_ts, left_id, right_id, True, strict)


def asof_previous(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, left_id: str, right_id: str, strict: bool = False) -> DataFrame:
    """For each left row the last right row at or before it."""
    return _asof(left, right, keys, left_ts, right_ts, left_id, right_id, False, strict)


def _union_on_clock(left, right, keys, left_ts, right_ts, left_id, right_id, right_side: int) -> DataFrame:
    """Both sides on one clock; ``right_side`` says whether right rows sort before (0) or after (2)
    left rows (1) of the same time."""
    a = left.select(*keys, epoch_us(F.col(left_ts)).alias("_t"), F.lit(1).alias("_o"), F.col(left_id).cast("string").alias("_id"))
    b = right.select(*keys, epoch_us(F.col(right_ts)).alias("_t"), F.lit(right_side).alias("_o"), F.col(right_id).cast("string").alias("_id"))
    return a.unionByName(b)


def _asof(left, right, keys, left_ts, right_ts, left_id, right_id, forward: bool, strict: bool) -> DataFrame:
    # forward lookups see equal times when the right row sorts after the left row, backward when before
    side = 2 if forward != strict else 0
    both = _union_on_clock(left, right, keys, left_ts, right_ts, left_id, right_id, side)
    mark = F.when(F.col("_o") == side, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    s = Scanner(both, keys, ["_t", "_o", "_id"]).add(_hit=last_value(mark, inclusive=False, reverse=forward))
    name = "next" if forward else "previous"
    kind = right.schema[right_id].dataType.simpleString()
    return s.df.where(F.col("_o") == 1).select(
        *keys,
        F.col("_id").cast(left.schema[left_id].dataType.simpleString()).alias(left_id),
        F.timestamp_micros("_t").alias(left_ts),
        F.col("_hit.id").cast(kind).alias(f"{name}_id"),
        F.timestamp_micros(F.col("_hit.t")).alias(f"{name}_ts"),
        F.abs(F.col("_hit.t") - F.col("_t")).alias("distance_us"),
    )


def near_in_time(left: DataFrame, right: DataFrame, seconds: float, keys: Sequence[str], left_ts: str, right_ts: str, left_id: str, right_id: str) -> DataFrame:
    """Left rows with right rows within +-``seconds``: how many, and the nearest (earlier one on ties).

    The count is the difference of two running counts, read at the ends of the window; nothing is
    bucketed and no pair is formed, so a dense moment costs no more than its rows.
    """
    width = int(seconds * 1e6)
    keys = list(keys)
    b = right.select(*keys, epoch_us(F.col(right_ts)).alias("_t"), F.lit(1).alias("_o"), F.col(right_id).cast("string").alias("_id"), F.lit(1).alias("_b"))
    at = epoch_us(F.col(left_ts))
    # _o orders rows of equal time: 0 reads before the rows of that time, 2 after them
    marks = F.explode(F.array(
        F.struct((at - width).alias("_t"), F.lit(0).alias("_o")),
        F.struct((at + width).alias("_t"), F.lit(2).alias("_o")),
        F.struct(at.alias("_t"), F.lit(3).alias("_o")),
    ))
    a = left.select(*keys, F.col(left_id).cast("string").alias("_id"), marks.alias("_m")).select(
        *keys, "_m._t", "_m._o", "_id", F.lit(0).alias("_b")
    )
    mark = F.when(F.col("_b") == 1, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    s = Scanner(b.unionByName(a), keys, ["_t", "_o", "_b", "_id"]).add(
        _n=running_sum(F.col("_b")),
        _before=last_value(mark),
        _after=last_value(mark, reverse=True),
    )
    got = s.df.where(F.col("_b") == 0).groupBy(*keys, "_id").agg(
        (F.max(F.when(F.col("_o") == 2, F.col("_n"))) - F.max(F.when(F.col("_o") == 0, F.col("_n")))).alias("n_near"),
        F.max(F.when(F.col("_o") == 3, F.struct("_t", "_before", "_after"))).alias("_x"),
    )
    gap_b = F.col("_x._t") - F.col("_x._before.t")
    gap_a = F.col("_x._after.t") - F.col("_x._t")
    use_before = gap_a.isNull() | (gap_b <= gap_a)
    kind = right.schema[right_id].dataType.simpleString()
    return got.where(F.col("n_near") > 0).select(
        *keys,
        F.col("_id").cast(left.schema[left_id].dataType.simpleString()).alias(left_id),
        F.col("n_near").cast("bigint").alias("n_near"),
        F.when(use_before, F.col("_x._before.id")).otherwise(F.col("_x._after.id")).cast(kind).alias("nearest_id"),
        F.when(use_before, gap_b).otherwise(gap_a).alias("distance_us"),
    )


def near_intervals(points: DataFrame, intervals: DataFrame, seconds: float, keys: Sequence[str], point_ts: str, point_id: str, start: str, end: str, interval_id: str) -> DataFrame:
    """Points inside intervals widened by ``seconds`` on both sides: how many are open, and the one
    that opened last before the point. A sweep, not a range join."""
    width = int(seconds * 1e6)
    keys = list(keys)
    s_us = epoch_us(F.col(start)) - width
    e_us = epoch_us(F.coalesce(F.col(end), F.col(start))) + width
    marks = F.explode(F.array(
        F.struct(s_us.alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d")),
        F.struct(e_us.alias("_t"), F.lit(2).alias("_o"), F.lit(-1).alias("_d")),
    ))
    iv = intervals.select(*keys, marks.alias("_m"), F.col(interval_id).cast("string").alias("_id"), e_us.alias("_e")).select(
        *keys, "_m._t", "_m._o", "_m._d", "_id", "_e"
    )
    pt = points.select(*keys, epoch_us(F.col(point_ts)).alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_d"), F.col(point_id).cast("string").alias("_id"), F.lit(None).cast("bigint").alias("_e"))
    opened = F.when(F.col("_d") == 1, F.struct("_t", F.col("_id").alias("id"), F.col("_e").alias("e")))
    s = Scanner(iv.unionByName(pt), keys, ["_t", "_o", "_id"]).add(_n=running_sum(F.col("_d")), _last=last_value(opened))
    hit = s.df.where((F.col("_d") == 0) & (F.col("_n") > 0))
    return hit.select(
        *keys,
        F.col("_id").cast(points.schema[point_id].dataType.simpleString()).alias(point_id),
        F.col("_n").cast("bigint").alias("n_open"),
        F.when(F.col("_last.e") >= F.col("_t"), F.col("_last.id")).alias("latest_id"),
    )
