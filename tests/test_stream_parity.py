"""Streams against their batch operators, with rows shuffled over the micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from test_runs import packets
from test_streaming import run, sec, stream

from sigspark.operators import dialogs, media
from sigspark.streaming import twins


def test_facts_merge_in_any_order():
    rng = random.Random(1)
    kinds = [("INVITE", None, True, None), ("INVITE", 200, False, "t"), ("INVITE", 486, False, "t"), ("INVITE", 487, False, "t"), ("BYE", None, True, "t"), ("CANCEL", None, True, None), ("REGISTER", None, True, None), ("REGISTER", 200, False, "t"), ("INVITE", 180, False, "t")]
    for _ in range(300):
        rows = [(rng.randrange(6), i, *rng.choice(kinds)) for i in range(rng.randint(1, 8))]
        whole = twins.DialogFacts()
        for r in rows:
            whole.add(*r)
        rng.shuffle(rows)
        cut = rng.randrange(len(rows) + 1)
        a, b = twins.DialogFacts(), twins.DialogFacts()
        for x, part in ((a, rows[:cut]), (b, rows[cut:])):
            for r in part:
                x.add(*r)
        b.merge(a)
        assert {k: v for k, v in b.parts.items() if v is not None} == {k: v for k, v in whole.parts.items() if v is not None} and b.state() == whole.state()


def test_dialog_states_equal_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(2)
    ddl = "call string, ord bigint, method string, status int, is_request boolean, to_tag string, ts timestamp"
    known = {
        "register": [("REGISTER", None, True, None), ("REGISTER", 200, False, "t")],
        "early-bye": [("INVITE", None, True, None), ("BYE", None, True, "t"), ("INVITE", 200, False, "t")],
        "refused": [("OPTIONS", None, True, None), ("OPTIONS", 404, False, "t")],
    }
    steps = [*known["early-bye"], ("INVITE", 486, False, "t"), ("INVITE", 487, False, "t"), ("CANCEL", None, True, None), ("INVITE", 180, False, "t"), ("REGISTER", None, True, None)]
    for i in range(25):
        known[f"x{i}"] = rng.choices(steps, k=rng.randint(1, 6))
    rows = [(call, n, *step, sec(n + rng.random())) for call, v in known.items() for n, step in enumerate(v)]
    rng.shuffle(rows)
    s = stream(spark, tmp_path / "in", [rows[:40], rows[40:70], rows[70:]], ddl)
    _, told = run(twins.dialog_state_stream(s, F.col("call"), "ts", "60 seconds", 600), "update", "parity", tmp_path / "d")
    last = {}
    for r in told:
        if r["n"] >= last.get(r["dialog"], (0, ""))[0]:
            last[r["dialog"]] = (r["n"], r["state"])
    batch = spark.createDataFrame(rows, ddl).select(
        "*", F.struct(F.col("method").alias("method")).alias("cseq"), F.lit("d").alias("dialog_tag"), F.lit("d").alias("from_tag"), F.col("ord").cast("string").alias("msg_id"),
        *[F.lit("").alias(c) for c in ("from_uri", "to_uri", "src", "dst", "transport")], F.col("call").alias("call_id"), F.lit(1).alias("sport"), F.lit(1).alias("dport"),
    )
    want = {r.call: (r.n_messages, r.state) for r in dialogs.dialog_state(batch, ["call"]).select("call", "n_messages", "state").collect()}
    assert last == want and want["register"][1] == "completed" and want["early-bye"][1] == "completed"


def test_stream_quality_equals_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(3)
    ddl = "ssrc int, seq int, rtp_ts bigint, ts timestamp"
    rows = [(k, s, 160 * i, sec(0.02 * i)) for k in range(3) for i, s in enumerate(packets(rng, 500))]
    late = rows[:]
    rng.shuffle(late)
    # every packet comes within the delay; the last ones only move the watermark
    batches = [late[:500], late[500:900], late[900:], [(9, 1, 0, sec(500))], [(9, 2, 0, sec(6_000))], [(9, 3, 0, sec(12_000))]]
    s = stream(spark, tmp_path / "in", batches, ddl)
    _, told = run(twins.stream_quality_stream(s, F.col("ssrc"), "ts", delay="60 seconds"), "update", "ordered", tmp_path / "q")
    got = {int(r["stream"]): (r["packets"], r["expected"], r["duplicates"], r["out_of_order"], r["resets"], r["lost"]) for r in told if int(r["stream"]) < 3}
    df = spark.createDataFrame(rows, ddl)
    want = {r.ssrc: (r.packets, r.expected, r.duplicates, r.out_of_order, r.resets, r.lost) for r in media.sequence_accounting(df, ["ssrc"], ["ts"], "seq").collect()}
    assert got == want and sum(w[4] for w in want.values()) > 0
    assert {int(r["stream"]) for r in told if r["expired"]} >= {0, 1, 2}
