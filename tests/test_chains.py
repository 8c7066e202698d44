"""Pieces met by a walk, against walking in order."""

import random

import pytest

from sigspark.operators.chains import reached
from sigspark.session import stage


def walk(rows):
    met, end = [], 0
    first = True
    for at, until, free in sorted(rows):
        if at >= end and (free or at == (0 if first else end)):
            met.append(at)
            first, end = False, until if until is not None else 10**9
    return met


@pytest.mark.parametrize("limit", ["2000000", "40"])
def test_walk_equals_walking_in_order(spark, limit):
    rng = random.Random(4)
    rows = []
    for key in range(60):
        n = 400 if key == 7 else rng.randint(1, 30)  # one key holds a third of all rows
        reach = rng.choice([2, 10, 60])
        for at in rng.sample(range(rng.choice([0, 3]), 3 * n + 3), n):
            rows.append((key, at, rng.choice([at + 1, at + rng.randint(1, reach), None if rng.random() < 0.05 else at + 2]), rng.random() < 0.6))
    df = stage(spark.createDataFrame(rows, "k int, at long, until long, free boolean"), "pieces")
    spark.conf.set("spark.sigspark.maxGroupRows", limit)
    try:
        got = {}
        for r in reached(df, ["k"], "at", "until", "free").collect():
            got.setdefault(r.k, []).append(r["at"])
        always = {}
        for r in reached(df, ["k"], "at", "until").collect():
            always.setdefault(r.k, []).append(r["at"])
    finally:
        spark.conf.unset("spark.sigspark.maxGroupRows")
    for k in range(60):
        mine = [r[1:] for r in rows if r[0] == k]
        assert sorted(got.get(k, [])) == walk(mine)
        assert sorted(always.get(k, [])) == walk([(a, u, True) for a, u, _ in mine])


def test_long_dependent_chain_takes_few_rounds(spark):
    # every piece covers the next one, so each depends on the one before
    df = stage(spark.range(4_000).selectExpr("0 k", "id at", "id + 2 until"), "pieces")
    got = sorted(r["at"] for r in reached(df, ["k"], "at", "until").collect())
    assert got == list(range(0, 4_000, 2))
