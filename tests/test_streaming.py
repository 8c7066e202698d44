"""Streaming forms against their batch results, driven to the end by availableNow."""

import datetime as dt

import time

import pytest
from pyspark.sql import functions as F

from sigspark.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def sec(s):
    return T0 + dt.timedelta(seconds=s)


def stream(spark, folder, batches, ddl):
    """A file stream of one micro-batch per file."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def run(df, mode, name, folder):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return q, [r.asDict(recursive=True) for r in df.sparkSession.table(name).collect()]


def test_dedup_and_counts(spark, tmp_path):
    ddl = "id int, leg string, ts timestamp"
    data = [[(1, "a", sec(0)), (2, "a", sec(1)), (3, "b", sec(1))], [(4, "a", sec(2)), (5, "c", sec(100))], [(6, "d", sec(300))]]
    s = stream(spark, tmp_path / "in", data, ddl)
    _, rows = run(twins.dedup_stream(s, ["leg"], "ts", "10 seconds"), "append", "dedup", tmp_path / "d")
    assert sorted(r["leg"] for r in rows) == ["a", "b", "c", "d"]
    _, rows = run(twins.repeat_counts_stream(s, ["leg"], "ts", "10 seconds", "60 seconds"), "append", "counts", tmp_path / "c")
    assert [(r["leg"], r["copies"]) for r in rows] == [("a", 3)]


def test_storm_alarm_is_exact(spark, tmp_path):
    ddl = "leg string, ts timestamp"
    data = [[("a", sec(0.1)), ("a", sec(0.2)), ("b", sec(0.9)), ("c", sec(1.4))], [("d", sec(50))], [("e", sec(200))], [("f", sec(400))]]
    s = stream(spark, tmp_path / "in", data, ddl)
    _, rows = run(twins.storm_alarms(s, "leg", "ts", "5 seconds", 3), "append", "storms", tmp_path / "s")
    assert [(r["window_start"], r["n_entities"], r["n_rows"]) for r in rows] == [(sec(0), 3, 4)]


def test_unanswered(spark, tmp_path):
    ddl = "id int, tx string, ts timestamp"
    q = stream(spark, tmp_path / "q", [[(1, "x", sec(0)), (2, "y", sec(1))], [(3, "z", sec(500))], [(4, "w", sec(900))]], ddl)
    r = stream(spark, tmp_path / "r", [[(10, "x", sec(2))], [(11, "z", sec(501))], [(12, "v", sec(900))]], ddl)
    _, rows = run(twins.unanswered_stream(q, r, ["tx"], "ts", "10 seconds", 32), "append", "unanswered", tmp_path / "u")
    got = {row["tx"]: row["response_id"] for row in rows}
    assert got["x"] == 10 and got["y"] is None and got["z"] == 11


def test_late_rows_are_counted(spark, tmp_path):
    ddl = "leg string, ts timestamp"
    s = stream(spark, tmp_path / "in", [[("a", sec(0))], [("b", sec(1000))], [("c", sec(1500))], [("late", sec(1))], [("d", sec(2000))]], ddl)
    late = twins.LateRows()
    spark.streams.addListener(late)
    q, _ = run(twins.event_time(s, "ts", "10 seconds").groupBy(F.window("ts", "10 seconds")).count(), "append", "late", tmp_path / "l")
    for _ in range(100):  # progress is told from another thread
        if late.of(q):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.of(q) == 1
    batch = spark.createDataFrame([("x", sec(1)), ("y", sec(9))], ddl)
    on_time, late = twins.split_late(batch, "ts", F.lit(sec(5)))
    assert (on_time.count(), late.count()) == (1, 1)


def dialog(call, t, *steps):
    return [(call, m, s, q, sec(t + i)) for i, (m, s, q) in enumerate(steps)]


INVITE, OK, BYE, CANCEL, GONE, BUSY = ("INVITE", None, True), ("INVITE", 200, False), ("BYE", None, True), ("CANCEL", None, True), ("INVITE", 487, False), ("INVITE", 486, False)


def test_dialog_states(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    ddl = "call string, method string, status int, is_request boolean, ts timestamp"
    data = [dialog("done", 0, INVITE, OK) + dialog("gone", 0, INVITE, CANCEL, GONE) + dialog("busy", 0, INVITE, BUSY) + dialog("open", 0, INVITE), dialog("done", 10, BYE), dialog("later", 5000, INVITE), dialog("last", 9000, INVITE)]
    s = stream(spark, tmp_path / "in", data, ddl)
    _, rows = run(twins.dialog_state_stream(s, F.col("call"), "ts", "5 seconds", 60), "update", "dialogs", tmp_path / "d")
    final = {}
    for r in rows:
        if r["last_ms"] >= final.get(r["dialog"], (0, ""))[0]:
            final[r["dialog"]] = (r["last_ms"], r["state"])
    assert {k: v[1] for k, v in final.items()} == {"done": "completed", "gone": "canceled", "busy": "failed", "open": "no-answer", "later": "no-answer", "last": "no-answer"}
    assert {r["dialog"] for r in rows if r["expired"]} >= {"done", "gone", "busy", "open"}


def test_stream_quality(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    ddl = "ssrc int, seq int, rtp_ts bigint, ts timestamp"
    packets = [(1, (65530 + i) % 65536, 160 * i, sec(0.02 * i)) for i in range(40) if i not in (7, 8)]
    s = stream(spark, tmp_path / "in", [packets[:20], packets[20:]], ddl)
    _, rows = run(twins.stream_quality_stream(s, F.col("ssrc"), "ts"), "update", "quality", tmp_path / "q")
    last = max(rows, key=lambda r: r["packets"])
    assert (last["packets"], last["expected"], last["lost"]) == (38, 40, 2) and last["jitter"] == pytest.approx(0, abs=1e-6)
