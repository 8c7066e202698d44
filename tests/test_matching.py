"""Containment by automaton and by grams; matching in one task and in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import linkage, matching


@pytest.mark.parametrize("rows", ["200000", "3"])
@pytest.mark.parametrize("min_len", [1, 4])
def test_containment_equals_looking_everywhere(spark, rows, min_len):
    rng = random.Random(9)
    text = lambda a, b: "".join(rng.choices("abé.", k=rng.randint(a, b)))
    needles = [(rng.choice(["x", "y", None]), text(0, 9)) for _ in range(60)] + [("x", None)]
    hays = [("x", text(0, 40)) for _ in range(150)] + [("y", text(0, 300)) for _ in range(20)] + [(None, "abab"), ("z", "ab"), ("x", None)]
    spark.conf.set("spark.sigspark.maxBroadcastRows", rows)
    try:
        found = matching.match_containment(spark.createDataFrame(needles, "capture_id string, n string"), spark.createDataFrame(hays, "capture_id string, h string"), "n", "h", min_len)
        got = [tuple(r) for r in found.select("capture_id", "n", "h").collect()]
        none = matching.match_containment(spark.createDataFrame([], "capture_id string, n string"), spark.createDataFrame(hays, "capture_id string, h string"), "n", "h")
        assert none.count() == 0
    finally:
        spark.conf.unset("spark.sigspark.maxBroadcastRows")
    want = {(s, n, h) for s, n in needles for t, h in hays if s and s == t and n and h and len(n) >= min_len and n in h and len(h) >= min_len}
    assert len(got) == len(set(got)) and set(got) == want


def in_order(pool, margin):
    used, settled, accepted, barred = set(), set(), [], []
    for p in sorted(pool, key=lambda p: (-p[3], p[1], p[0], p[2])):
        if p[0] in used or p[2] in settled:
            continue
        settled.add(p[2])
        if any(q is not p and q[2] == p[2] and q[0] not in used and p[3] - q[3] <= margin for q in pool):
            barred.append(p[2])
        else:
            accepted.append((p[0], p[2]))
            used.add(p[0])
    return sorted(accepted), sorted(barred)


@pytest.mark.parametrize("limit", ["500000", "12"])
def test_matching_in_one_task_or_in_rounds(spark, limit):
    rng = random.Random(10)
    pools = {}
    for scope in range(25):
        n = 60 if scope == 3 else rng.randint(1, 12)
        edges = {(f"i{rng.randrange(n)}", f"e{rng.randrange(n)}"): rng.randrange(500, 1_000) for _ in range(n)}
        pools[scope] = [(i, int(i[1:]) % 5, e, s) for (i, e), s in edges.items()]
    df = spark.createDataFrame([(k, *p) for k, v in pools.items() for p in v], "g int, ingress string, t long, egress string, score long")
    spark.conf.set("spark.sigspark.maxMatchPairs", limit)
    try:
        accepted, barred = linkage.match_greedy(df, ["g"])
        got, lost = accepted.collect(), barred.collect()
    finally:
        spark.conf.unset("spark.sigspark.maxMatchPairs")
    for k, pool in pools.items():
        a, b = in_order(pool, 150)
        assert sorted((r.ingress, r.egress) for r in got if r.g == k) == a and sorted(r.egress for r in lost if r.g == k) == b


def test_ten_thousand_pairs_that_depend_on_each_other(spark):
    # each egress has a rival that an earlier pair takes away
    n = 10_000
    own = spark.range(n).select(F.lit(1).alias("g"), F.format_string("i%06d", "id").alias("ingress"), F.col("id").alias("t"), F.format_string("e%06d", "id").alias("egress"), (1_000_000 - 2 * F.col("id")).alias("score"))
    rival = own.select("g", "ingress", "t", F.format_string("e%06d", F.col("t") + 1).alias("egress"), (F.col("score") - 1).alias("score"))
    accepted, barred = linkage.match_greedy(own.unionByName(rival), ["g"], 0)
    assert accepted.count() == n and barred.count() == 0


def test_labels_need_anchor_and_pattern(spark):
    from sigspark.functions.sip import parse_messages
    from sigspark.operators.labels import LabelRule, label_texts, rule_table
    from sigspark.plans import profile_sip

    rules = rule_table(spark, [LabelRule("a", "X-"), LabelRule("a", "zz"), LabelRule("b", "x-", r"x-\d+$"), LabelRule("c", "")])
    texts = spark.createDataFrame([(1, "ax-7"), (1, "AX-7"), (2, "x-7b zz"), (3, None), (4, "none"), (None, "X-12")], "k int, t string")
    got = sorted(((r.k, r.label) for r in label_texts(texts, rules, ["k"], "t").collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "b")], key=repr)
    raw = "OPTIONS sip:a@b SIP/2.0\r\nUser-Agent: FreePBX 15\r\nServer: Oracle SBC\r\n\r\n"
    parsed = parse_messages(spark.createDataFrame([("c", raw), ("c", raw), ("d", "OPTIONS sip:a@b SIP/2.0\r\n\r\n")], "capture_id string, raw string"))
    assert sorted((r.capture_id, r.vendor) for r in profile_sip.vendors(parsed).collect()) == [("c", "asterisk"), ("c", "oracle-acme")]
