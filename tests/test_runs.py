"""Sequence runs that merge, and named pairing cut into busy periods."""

import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import media, pairing


def packets(rng, n):
    seq, out = rng.randrange(65_536), []
    while len(out) < n:
        r = rng.random()
        if r < 0.002:
            seq += rng.randrange(4_000, 60_000)
        elif r < 0.02:
            out.append((seq + rng.randrange(3_000, 60_000)) % 65_536)
        elif r < 0.06:
            out.append((seq - rng.randrange(0, 150)) % 65_536)
        seq += 1 if rng.random() < 0.95 else rng.randrange(1, 40)
        out.append(seq % 65_536)
    return out[:n]


@pytest.mark.parametrize(("first", "least"), [(8, 0), (200, 20), (1_024, 45)])
def test_summaries_merge_to_the_whole_run(monkeypatch, first, least):
    monkeypatch.setattr(media.RunSummary, "FIRST", first)
    rng = random.Random(2)
    settled = 0
    for _ in range(60):
        seqs = packets(rng, rng.choice([5, 300, 4_000]))
        whole = media.SequenceWindow()
        for x in seqs:
            whole.take(x)
        cuts = sorted({0, len(seqs), *(rng.randrange(len(seqs)) for _ in range(rng.randint(1, 6)))})
        runs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            runs.append(media.RunSummary())
            for x in seqs[a:b]:
                runs[-1].take(x)
        runs = [media.RunSummary.read(r.write()) for r in runs]
        left = media.RunSummary()
        ok = all([left.merge(r) for r in runs])
        # the other way of bracketing
        right = [media.RunSummary.read(r.write()) for r in runs]
        while len(right) > 1 and ok:
            last = right.pop()
            ok = right[-1].merge(last)
        if ok:
            settled += 1
            assert left.window.totals() == whole.totals() == right[0].window.totals() and left.window.place() == whole.place()
    assert settled >= least


@pytest.mark.parametrize("first", [4, 1_024])
def test_long_streams_are_read_in_slices(spark, monkeypatch, first):
    monkeypatch.setattr(media.RunSummary, "FIRST", first)
    rng = random.Random(3)
    streams = {0: packets(rng, 6_000), 1: packets(rng, 300), 2: packets(rng, 900)}
    rows = [(k, i, s) for k, v in streams.items() for i, s in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, seq int").repartition(5)
    spark.conf.set("spark.sigspark.maxGroupRows", "800")
    try:
        got = {r.k: tuple(r)[1:6] for r in media._replay_sequence(df, ["k"], ["i"], "seq").collect()}
    finally:
        spark.conf.unset("spark.sigspark.maxGroupRows")
    for k, v in streams.items():
        w = media.SequenceWindow()
        for x in v:
            w.take(x)
        assert got[k] == w.totals()


def in_order(rows):
    pairs, orphans, waiting = {}, set(), {}
    for k, _, i, rq, name in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        line = waiting.setdefault(k, [])
        if rq:
            line.append((i, name))
            pairs[k, i] = None
            continue
        hit = next((x for x in line if name is None or x[1] is None or x[1] == name), line[0] if line else None)
        if hit is None:
            orphans.add((k, i))
        else:
            line.remove(hit)
            pairs[k, hit[0]] = i
    return pairs, orphans


@pytest.mark.parametrize("limit", ["2000000", "60"])
def test_named_pairs_equal_pairing_in_order(spark, limit):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        n = 700 if k == 4 else rng.randint(1, 50)  # one key holds about half of all rows
        names = rng.choice([["a"], ["a", "b"], ["a", "b", "c", None]])
        level = 0
        for i in range(n):
            # open requests come back to 0 now and then
            rq = rng.random() < (0.7 if level < 3 else 0.3)
            level = max(0, level + (1 if rq else -1))
            rows.append((k, i // 2, i, rq, rng.choice(names)))
    df = spark.createDataFrame(rows, "k int, ts int, id int, rq boolean, name string").withColumn("ts", F.timestamp_seconds("ts")).repartition(5)
    spark.conf.set("spark.sigspark.maxGroupRows", limit)
    try:
        pairs, orphans = pairing.pair_named(df, ["k"], F.col("rq"), "ts", "id", "name")
        got = {(r.k, r.request_id): r.response_id for r in pairs.collect()}
        left = {(r.k, r.id) for r in orphans.collect()}
    finally:
        spark.conf.unset("spark.sigspark.maxGroupRows")
    want, lost = in_order(rows)
    assert got == want and left == lost and orphans.columns == df.columns


def test_equal_rows_stay_two_rows(spark):
    rows = [(1, 0, "x", True, "a"), (1, 0, "x", True, "a"), (1, 5, "y", False, None), (1, 9, "z", False, "b")]
    df = spark.createDataFrame(rows, "k int, ts int, id string, rq boolean, name string").withColumn("ts", F.timestamp_seconds("ts"))
    pairs, orphans = pairing.pair_named(df, ["k"], F.col("rq"), "ts", "id", "name")
    assert sorted(r.response_id for r in pairs.collect()) == ["y", "z"] and orphans.count() == 0
    pairs, _ = pairing.pair_named(df.where("id != 'z'"), ["k"], F.col("rq"), "ts", "id", "name")
    assert sorted(str(r.response_id) for r in pairs.collect()) == ["None", "y"]
