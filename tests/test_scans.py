"""Scans over sliced hot keys against plain Python, and the operators built on them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import ordered, repeats
from sigspark.plans.slices import (
    Scanner,
    first_value,
    lag,
    last_value,
    lead,
    row_number,
    running_max,
    running_min,
    running_sum,
    slice_rows,
)
from sigspark.session import GROUP_ROWS_CONF


def rows(seed=3, n=900):
    """Two thirds of all rows under one key; nulls and equal times included."""
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randint(0, 300), i, rnd.choice([None, *range(-20, 20)])) for i in range(n)]


@pytest.fixture(scope="module", params=[50, 10**6], ids=["sliced", "plain"])
def small_groups(request, spark):
    spark.conf.set(GROUP_ROWS_CONF, str(request.param))
    yield request.param
    spark.conf.unset(GROUP_ROWS_CONF)


def test_every_scan(spark, small_groups):
    data = rows()
    df = spark.createDataFrame(data, "k string, t int, id int, v int")
    s = Scanner(df, ["k"], ["t", "id"])
    assert (s.n_hot > 0) == (small_groups == 50)
    v = F.col("v")
    s.add(
        s=running_sum(v), mx=running_max(v, inclusive=False), mn=running_min(v), rn=row_number(), last=last_value(v), first=first_value(v),
        before=lag(v), after=lead(v), nxt=last_value(v, inclusive=False, reverse=True), tail=running_sum(v, reverse=True, inclusive=False),
    )
    got = {r["id"]: r for r in s.df.collect()}
    assert len(got) == len(data)
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        vals = [r[3] for r in group]
        for i, (_, _, rid, _) in enumerate(group):
            upto, prior, later = ([x for x in part if x is not None] for part in (vals[: i + 1], vals[:i], vals[i + 1 :]))
            g = got[rid]
            assert g["s"] == (sum(upto) if upto else None)
            assert g["mx"] == (max(prior) if prior else None)
            assert g["mn"] == (min(upto) if upto else None)
            assert g["rn"] == i + 1
            assert g["last"] == (upto[-1] if upto else None)
            assert g["first"] == (upto[0] if upto else None)
            assert g["before"] == (vals[i - 1] if i else None)
            assert g["after"] == (vals[i + 1] if i + 1 < len(vals) else None)
            assert g["nxt"] == (later[0] if later else None)
            assert g["tail"] == (sum(later) if later else None)


def test_slices_are_balanced_and_ordered(spark):
    df = spark.createDataFrame(rows(), "k string, t int, id int, v int")
    sliced, n_hot, n_slices = slice_rows(df, ["k"], F.col("t"), 100)
    assert n_hot >= 1 and n_slices >= 2
    per = sliced.where("k = 'hot'").groupBy("_slice").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_slice").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:], strict=False))
    assert max(r["n"] for r in per) < 200


def stamp(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


def test_burst_windows_against_brute_force(spark, small_groups):
    rnd = random.Random(5)
    data = [("c", stamp(rnd.randint(0, 60_000_000)), f"e{rnd.randint(0, 6)}", i) for i in range(160)]
    df = spark.createDataFrame(data, "capture_id string, ts timestamp, leg string, id int")
    got = [(r["start_ts"], r["end_ts"], r["n_entities"], r["n_rows"]) for r in repeats.burst_windows(df, "ts", 2, "leg", 5, ["capture_id"], ["id"]).orderBy("start_ts").collect()]
    ev = sorted((r[1], r[2]) for r in data)
    two = dt.timedelta(seconds=2)
    hits = sorted({t for t, _ in ev if len({e for u, e in ev if t - two <= u <= t}) >= 5})
    isles = []
    for t in hits:
        if isles and t - isles[-1][-1] <= two:
            isles[-1].append(t)
        else:
            isles.append([t])
    want = []
    for isle in isles:
        inside = [(u, e) for u, e in ev if any(t - two <= u <= t for t in isle)]
        want.append((min(inside)[0], max(inside)[0], len({e for _, e in inside}), len(inside)))
    assert got == want and want


def test_over_limit_and_peak(spark, small_groups):
    rnd = random.Random(6)
    data = [(rnd.choice("xy"), stamp(rnd.randint(0, 50) * 1_000_000), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, ts timestamp, id int")
    got = {r["id"]: r["hits_before"] for r in ordered.over_limit(df, ["k"], "ts", 3, 4, ["id"]).collect()}
    want = {}
    for k, t, i in data:
        n = sum(1 for k2, t2, i2 in data if k2 == k and t2 > t - dt.timedelta(seconds=3) and (t2, i2) < (t, i))
        if n >= 4:
            want[i] = n
    assert got == want
    spans = [(k, t, t + dt.timedelta(seconds=rnd.randint(0, 9))) for k, t, _ in data]
    peak = {r["k"]: r["peak"] for r in ordered.peak_concurrency(spark.createDataFrame(spans, "k string, s timestamp, e timestamp"), "s", "e", ["k"]).collect()}
    assert peak == {k: max(sum(1 for k3, s3, e3 in spans if k3 == k and s3 <= s <= e3) for k2, s, _ in spans if k2 == k) for k in "xy"}


def test_ewma_is_the_sequential_filter(spark, small_groups):
    rnd = random.Random(7)
    data = [("s", i, None if rnd.random() < 0.1 else rnd.random() * 50) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, i int, x double")
    got = {r["i"]: r["ewma"] for r in ordered.ewma(df, ["k"], ["i"], "x", chunk=64).collect()}
    j = 0.0
    for _, i, x in data:
        j += (x - j) / 16 if x is not None else 0.0
        assert got[i] == pytest.approx(j, rel=1e-9, abs=1e-9)


def test_gap_clock_does_not_go_back(spark):
    data = [("k", stamp(t), n) for n, t in enumerate([0, 1_000_000, 500_000, 1_050_000, 1_300_000])]
    df = spark.createDataFrame(data, "k string, ts timestamp, n int")
    assert [(r["n"], r["gap_ms"]) for r in ordered.gaps(df, ["k"], "ts", 0.1, ["n"]).orderBy("n").collect()] == [(1, 1000.0), (4, 250.0)]


def test_fold_events(spark):
    data = [("s", 1, 5, 100, 80, False), ("s", 2, 5, 100, 160, False), ("s", 3, 5, 100, 240, True), ("s", 4, 5, 100, 240, True), ("s", 5, 6, 900, 80, True)]
    df = spark.createDataFrame(data, "k string, n int, event int, rtp_ts int, dur int, done boolean")
    got = [(r["event"], r["duration_units"]) for r in ordered.fold_events(df, ["k"], ["n"], ["event", "rtp_ts"], "dur", "done").orderBy("event_no").collect()]
    assert got == [(5, 240), (5, 240), (6, 80)]  # a repeated end packet opens an event of its own
