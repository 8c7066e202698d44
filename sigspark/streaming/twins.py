"""Structured Streaming forms of the batch operators. Times are event times; late rows are counted."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from sigspark.operators.dialogs import KIND_BY_METHOD
from sigspark.operators.media import SequenceWindow


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked stream; a time without zone is taken in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row of each repeat group while the watermark remembers it."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def repeat_counts_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str, width: str) -> DataFrame:
    """Copies of each group per window: what the deduplicated stream leaves out stays counted."""
    w = F.window(ts, width).alias("w")
    out = event_time(df, ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("copies"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.where(F.col("copies") >= 2).select(F.col("w.start").alias("window_start"), *keys, "copies", "first_ts", "last_ts")


def entity_windows_stream(df: DataFrame, entity: str, ts: str, delay: str, width: str = "2 seconds", slide: str = "1 second", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per entity and sliding window: the exact first half of the storm alarm.

    A window closes with one row per entity, so counting those rows downstream (``storm_alarms``)
    gives the exact number of entities without holding a set in state.
    """
    w = F.window(ts, width, slide).alias("w")
    out = event_time(df, ts, delay).groupBy(w, *keys, entity).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.select("w", *keys, entity, "n_rows")


def storm_alarms(df: DataFrame, entity: str, ts: str, delay: str, min_entities: int, width: str = "2 seconds", slide: str = "1 second", keys: Sequence[str] = ()) -> DataFrame:
    """Windows with at least ``min_entities`` entities: two chained aggregations, both exact."""
    per_entity = entity_windows_stream(df, entity, ts, delay, width, slide, keys)
    out = per_entity.groupBy("w", *keys).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_rows").alias("n_rows"))
    return out.where(F.col("n_entities") >= min_entities).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_entities", "n_rows"
    )


def unanswered_stream(requests: DataFrame, responses: DataFrame, keys: Sequence[str], ts: str, delay: str, timeout_s: int) -> DataFrame:
    """Requests with their first-come response inside the timeout, or nulls once it has passed."""
    q = event_time(requests, ts, delay).select(*keys, *[F.col(c).alias("request_" + c) for c in requests.columns if c not in keys])
    r = event_time(responses, ts, delay).select(
        *[F.col(k).alias("_r_" + k) for k in keys], *[F.col(c).alias("response_" + c) for c in responses.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col("_r_" + k))
    qt, rt = F.col("request_" + ts), F.col("response_" + ts)
    cond = cond & (rt >= qt) & (rt <= qt + F.expr(f"INTERVAL {timeout_s} SECONDS"))
    return q.join(r, cond, "leftOuter").drop(*["_r_" + k for k in keys])


class DialogFacts:
    """What decides about the state of a dialog: earliest and latest times of some kinds of messages.

    All parts are minima, maxima and sums, so facts merge in any order and bracketing, and rows may come in any order. The state is
    read from them by the rules of ``dialogs.dialog_state``; a stream and a batch over the same rows agree.
    """

    LEAST, MOST, SUMS = ("first", "ok", "call_fail", "any_ok", "any_fail", "cancel", "invite", "bye"), ("gone", "last"), ("n",)

    def __init__(self, parts: dict | None = None):
        self.parts = parts or {}

    def _put(self, name: str, value) -> None:
        old = self.parts.get(name)
        if value is None or old is None:
            self.parts[name] = old if value is None else value
        elif name in self.SUMS:
            self.parts[name] = old + value
        else:
            self.parts[name] = min(old, value) if name in self.LEAST else max(old, value)

    def add(self, us: int, ord_: int, method: str | None, status: int | None, is_request: bool, to_tag: str | None) -> None:
        at = [us, ord_]
        self._put("n", 1)
        self._put("last", us)
        self._put("first", [*at, is_request, method or "", not to_tag])
        if is_request:
            for name, wanted in (("invite", "INVITE"), ("bye", "BYE"), ("cancel", "CANCEL")):
                if method == wanted:
                    self._put(name, at)
        elif status is not None and status >= 200:
            self._put("any_ok" if status < 300 else "any_fail", [*at, status])
            if method == "INVITE":
                self._put("ok" if status < 300 else "call_fail", [*at, status])
                if status == 487:
                    self._put("gone", at)

    def merge(self, other: DialogFacts) -> None:
        for name, value in other.parts.items():
            self._put(name, value)

    def state(self) -> str:
        p = self.parts.get
        _, _, is_request, method, untagged = self.parts["first"]
        if not (is_request and untagged and KIND_BY_METHOD.get(method) == "call"):
            return "completed" if p("any_ok") else "failed" if p("any_fail") else "in-progress"
        if p("ok") and p("bye"):
            return "completed"
        if p("cancel") and p("gone") and p("cancel") < p("gone"):
            return "canceled"
        if p("ok"):
            return "answered"
        return "failed" if p("call_fail") else "no-answer" if p("invite") else "in-progress"


class DialogState(StatefulProcessor):
    """Call state per dialog key: emits each change, and 'expired' after an idle time.

    The state is the facts of one open dialog; an event-time timer removes it.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("dialog", "facts string")

    def _row(self, key: Any, facts: DialogFacts, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), facts.state(), facts.parts["n"], facts.parts["last"] // 1_000, expired)], columns=["dialog", "state", "n", "last_ms", "expired"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        facts = DialogFacts(json.loads(self.facts.get()[0]) if self.facts.exists() else None)
        for frame in rows:
            for method, status, is_request, us, ord_, to_tag in zip(*(frame[c] for c in ("method", "status", "is_request", "us", "ord", "to_tag")), strict=True):
                facts.add(int(us), int(ord_), method, None if pd.isna(status) else int(status), bool(is_request), None if pd.isna(to_tag) else to_tag)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.facts.update((json.dumps(facts.parts),))
        self.handle.registerTimer(facts.parts["last"] // 1_000 + self.idle_ms)
        yield self._row(key, facts, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        facts = DialogFacts(json.loads(self.facts.get()[0]))
        self.facts.clear()
        yield self._row(key, facts, True)

    def close(self) -> None:
        pass


DIALOG_OUT = "dialog string, state string, n long, last_ms long, expired boolean"


def dialog_state_stream(df: DataFrame, key: Column, ts: str, delay: str, idle_s: int) -> DataFrame:
    """State changes of dialogs; rows need method (of responses: that of their CSeq), status, is_request, and may have ord and
    to_tag. Idle dialogs expire."""
    may = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    base = event_time(df, ts, delay).select(
        key.cast("string").alias("dialog_key"), ts, "method", "status", "is_request", F.unix_micros(ts).alias("us"),
        F.coalesce(may("ord", "bigint"), F.lit(0).cast("bigint")).alias("ord"), may("to_tag", "string").alias("to_tag"),
    )
    return base.groupBy("dialog_key").transformWithStateInPandas(
        statefulProcessor=DialogState(idle_s * 1000), outputStructType=DIALOG_OUT, outputMode="Update", timeMode="EventTime"
    )


class StreamCounters(StatefulProcessor):
    """Loss and jitter of media streams by the rules of the batch operators, restarts and repeats included.

    With ``hold`` packets wait until the watermark has passed them and are then taken in order of time, so the
    answer does not depend on the micro-batch they came with; a stream idle for ``idle_ms`` is forgotten. Without it packets are taken
    as they come, in order within a micro-batch, and streams stay.
    """

    def __init__(self, hold: bool, idle_ms: int):
        self.hold, self.idle_ms = hold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", "run string")
        if self.hold:
            self.waiting = handle.getListState("waiting", "us long, seq long, rtp_ts long, rate long")

    def _take(self, key: Any, packets: list[tuple], expired: bool = False) -> pd.DataFrame:
        window, jitter, last_rtp, last_us = SequenceWindow(), 0.0, 0, 0
        if self.state.exists():
            (window.base, window.high, window.follows, window.seen, window.counts), jitter, last_rtp, last_us = json.loads(self.state.get()[0])
        for us, seq, rtp, rate in sorted(packets):
            if window.high is not None:
                step = (rtp - last_rtp + 2**31) % 2**32 - 2**31
                d = abs((us - last_us) / 1e6 * rate - step)
                if d <= rate * 10:
                    jitter += (d - jitter) / 16
            window.take(seq)
            last_rtp, last_us = rtp, us
        self.state.update((json.dumps([[window.base, window.high, window.follows, window.seen, window.counts], jitter, last_rtp, last_us]),))
        n, span, repeats, late, resets = window.totals()
        expected = max(span, n - repeats)
        row = (str(key[0]), n, expected, max(0, expected - (n - repeats)), repeats, late, resets, jitter, expired)
        return pd.DataFrame([row], columns=["stream", "packets", "expected", "lost", "duplicates", "out_of_order", "resets", "jitter", "expired"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(map(int, r)) for frame in rows for r in zip(*(frame[c] for c in ("us", "seq", "rtp_ts", "rate")), strict=True)]
        if not self.hold:
            yield self._take(key, new)
            return
        yield from self._release(key, new, timerValues.getCurrentWatermarkInMs())

    def _release(self, key: Any, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = [tuple(map(int, r)) for r in self.waiting.get()] + new if self.waiting.exists() else new
        ready = [p for p in held if p[0] < watermark_ms * 1_000]
        rest = [p for p in held if p[0] >= watermark_ms * 1_000]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if ready:
            yield self._take(key, ready)
        if rest:
            self.handle.registerTimer(max(p[0] for p in rest) // 1_000 + 1)
        elif self.state.exists():
            last_us = json.loads(self.state.get()[0])[3]
            self.handle.registerTimer(max(last_us // 1_000, watermark_ms) + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield from self._release(key, [], timerValues.getCurrentWatermarkInMs())
        else:
            yield self._take(key, [], True)
            self.state.clear()

    def close(self) -> None:
        pass


STREAM_OUT = "stream string, packets long, expected long, lost long, duplicates long, out_of_order long, resets long, jitter double, expired boolean"


def stream_quality_stream(packets: DataFrame, key: Column, ts: str, rate: int = 8000, delay: str | None = None, idle_s: int = 3600) -> DataFrame:
    """Running packets, expected, lost, repeats, restarts and jitter (clock units) per media stream.

    ``delay`` is how late a packet may come: they are then put in order before they count.
    """
    rows = event_time(packets, ts, delay) if delay else packets.withColumn(ts, F.col(ts).cast("timestamp"))
    base = rows.select(key.cast("string").alias("stream_key"), *([ts] if delay else []), "seq", "rtp_ts", F.unix_micros(ts).alias("us"), F.lit(rate).alias("rate"))
    return base.groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=StreamCounters(bool(delay), idle_s * 1000), outputStructType=STREAM_OUT, outputMode="Update", timeMode="EventTime" if delay else "None"
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, over all batches of each query; add it before the queries start."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        n = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.id), 0)


def split_late(batch: DataFrame, ts: str, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of a micro-batch: for a dead-letter table inside foreachBatch."""
    late = F.coalesce(F.col(ts) < watermark, F.lit(False))
    return batch.where(~late), batch.where(late)
