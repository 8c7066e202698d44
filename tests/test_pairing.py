"""Pairing, linkage and dialogs against the sequential rules, on random data with hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import linkage, manip, media, pairing
from sigspark.operators.dialogs import group_dialogs
from sigspark.session import GROUP_ROWS_CONF


@pytest.fixture(scope="module", autouse=True, params=[40], ids=["sliced"])
def small_groups(request, spark):
    tiny = {GROUP_ROWS_CONF: str(request.param), "spark.sql.codegen.wholeStage": "false"}
    for k, v in tiny.items():
        spark.conf.set(k, v)
    yield
    for k in tiny:
        spark.conf.unset(k)


def stamp(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


def traffic(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "x", "y"]), stamp(i * 1000 + rnd.randint(0, 900)), i, rnd.random() < 0.55, rnd.choice(["a", "b", "c"])) for i in range(n)]


DDL = "k string, ts timestamp, id int, rq boolean, name string"


def sequential_pairs(data, named):
    waiting, out, orphans = {}, {}, set()
    for k, ts, i, rq, name in sorted(data, key=lambda r: (r[1], r[2])):
        queue = waiting.setdefault(k, [])
        if rq:
            queue.append((i, name))
            out[i] = None
            continue
        hit = next((j for j, (_, n) in enumerate(queue) if not named or n == name), 0 if queue else None)
        if hit is None:
            orphans.add(i)
        else:
            out[queue.pop(hit)[0]] = i
    return out, orphans


@pytest.mark.parametrize("seed", [1])
def test_fifo(spark, seed):
    data = traffic(seed)
    pairs, orphans = pairing.pair_fifo(spark.createDataFrame(data, DDL), ["k"], F.col("rq"), "ts", "id")
    want, lost = sequential_pairs(data, False)
    assert {r["request_id"]: r["response_id"] for r in pairs.collect()} == want
    assert {r["id"] for r in orphans.collect()} == lost


@pytest.mark.parametrize("seed", [3])
def test_named(spark, seed):
    data = traffic(seed) + [("clean", stamp(5_000_000 + i * 10), 1000 + i, i % 4 < 2, "ab"[i % 2]) for i in range(40)]
    pairs, orphans = pairing.pair_named(spark.createDataFrame(data, DDL), ["k"], F.col("rq"), "ts", "id", "name")
    want, lost = sequential_pairs(data, True)
    assert {r["request_id"]: r["response_id"] for r in pairs.collect()} == want
    assert {r["id"] for r in orphans.collect()} == lost


def test_near_and_asof(spark):
    data = traffic(5)
    df = spark.createDataFrame(data, DDL)
    left, right = df.where("rq"), df.where("NOT rq")
    near = {r["id"]: (r["n_near"], r["distance_us"]) for r in pairing.near_in_time(left, right, 0.004, ["k"], "ts", "ts", "id", "id").collect()}
    nxt = {r["id"]: r["next_id"] for r in pairing.asof_next(left, right, ["k"], "ts", "ts", "id", "id").collect()}
    prev = {r["id"]: r["previous_id"] for r in pairing.asof_previous(left, right, ["k"], "ts", "ts", "id", "id").collect()}
    for k, ts, i, rq, _ in data:
        if not rq:
            continue
        others = [(t, j) for k2, t, j, q, _ in data if k2 == k and not q]
        close = [abs((t - ts).total_seconds()) for t, _ in others if abs((t - ts)) <= dt.timedelta(milliseconds=4)]
        assert near.get(i) == ((len(close), round(min(close) * 1e6)) if close else None)
        assert nxt[i] == min(((t, j) for t, j in others if t >= ts), default=(0, None))[1]
        assert prev[i] == max(((t, j) for t, j in others if t <= ts), default=(0, None))[1]


def test_near_intervals(spark):
    rnd = random.Random(9)
    spans = [("k", stamp(s), stamp(s + rnd.randint(0, 3_000_000)), i) for i, s in enumerate(rnd.randint(0, 20_000_000) for _ in range(60))]
    points = [("k", stamp(rnd.randint(0, 25_000_000)), i) for i in range(60)]
    got = {r["id"]: r["n_open"] for r in pairing.near_intervals(
        spark.createDataFrame(points, "k string, ts timestamp, id int"), spark.createDataFrame(spans, "k string, s timestamp, e timestamp, iv int"),
        0.5, ["k"], "ts", "id", "s", "e", "iv").collect()}
    half = dt.timedelta(milliseconds=500)
    want = {i: n for _, t, i in points if (n := sum(1 for _, s, e, _ in spans if s - half <= t <= e + half))}
    assert got == want


SPEC = linkage.Linkage(
    scope=("g",), attributes=("a", "b", "c"),
    signals=(
        linkage.Signal("a", 450, lambda x, y: x["a"] == y["a"]), linkage.Signal("b", 300, lambda x, y: x["b"] == y["b"]), linkage.Signal("c", 100, lambda x, y: x["c"] == y["c"]),
    ),
    blocks=(linkage.Block(("a", "b")), linkage.Block(("a", "c")), linkage.Block(("a",), near=True), linkage.Block(("b", "c"), near=True)),
    proximity=linkage.Proximity(150, 250_000),
)


def sequential_link(nodes):
    """All pairs, ambiguity, greedy matching with contention, chains: the plain rules in order."""
    pairs = []
    ns = sorted(nodes, key=lambda n: (n["t"], n["ord"]))
    for i, x in enumerate(ns):
        for y in ns[i + 1 :]:
            base = 450 * (x["a"] == y["a"]) + 300 * (x["b"] == y["b"]) + 100 * (x["c"] == y["c"])
            d = y["t"] - x["t"]
            score = min(1000, int(base + (150 * (250_000 - d) / 250_000 if d < 250_000 else 0) + 0.5))
            if score >= 500:
                pairs.append((-score, x["t"], x["id"], y["id"]))
    pairs.sort()
    per = {}
    for p in pairs:
        per.setdefault(p[2], []).append(-p[0])
    unclear = {i for i, s in per.items() if len(s) > 1 and s[0] - s[1] <= 150}
    pool = [p for p in pairs if p[2] not in unclear]
    used_in, used_eg, barred, accepted = set(), set(), set(), []
    for p in pool:
        if p[2] in used_in or p[3] in used_eg or p[3] in barred:
            continue
        if any(q is not p and q[3] == p[3] and q[2] not in used_in and -p[0] + q[0] <= 150 for q in pool):
            barred.add(p[3])
            continue
        accepted.append((p[2], p[3], -p[0]))
        used_in.add(p[2])
        used_eg.add(p[3])
    up = {e: i for i, e, _ in accepted}

    def root(n):
        while n in up:
            n = up[n]
        return n

    return per, unclear, {(i, e, s) for i, e, s in accepted}, {n["id"]: root(n["id"]) for n in nodes}, barred


@pytest.mark.parametrize("seed", [11, 12])
def test_linkage(spark, seed):
    rnd = random.Random(seed)
    nodes = []
    for i in range(90):
        # few values: large groups of copies, many ties, many rivals
        wide = rnd.random() < 0.6
        nodes.append({"id": f"n{i:03d}", "ord": f"{i:03d}", "t": rnd.randint(0, 3_000_000), "a": f"a{rnd.randint(0, 40 if wide else 3)}", "b": f"b{rnd.randint(0, 30 if wide else 2)}", "c": rnd.choice(["c1", "c2", None])})
    df = spark.createDataFrame([("g", n["id"], stamp(n["t"]), n["ord"], n["a"], n["b"], n["c"]) for n in nodes], "g string, node_id string, start_ts timestamp, ord string, a string, b string, c string")
    for n in nodes:
        n["c"] = n["c"] or object()  # null equals nothing
    per, unclear, accepted, roots, barred = sequential_link(nodes)
    out = linkage.link(df, SPEC)
    ranked = {r["node_id"]: r for r in linkage.rank_candidates(out["candidates"], SPEC).collect()}
    assert {i: (len(s), s[0], s[1] if len(s) > 1 else None) for i, s in per.items()} == {i: (r["n_candidates"], r["best"], r["second"]) for i, r in ranked.items()}
    assert {r["node_id"] for r in out["ambiguous"].collect()} == unclear
    assert {(r["ingress"], r["egress"], r["score"]) for r in out["accepted"].collect()} == accepted
    assert {r["egress"] for r in out["contended"].collect()} == barred
    assert {r["node_id"]: r["root"] for r in out["call_nodes"].collect()} == roots


@pytest.mark.parametrize("seed", [21, 22])
def test_dialogs(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice(["c1", "c1", "c2", "c3"]), i, rnd.choice([None, *"ABCDEF"]), rnd.choice([None, *"ABCDEF"])) for i in range(160)]
    out = group_dialogs(spark.createDataFrame(data, "call string, n int, f string, t string"), ["call"], "f", "t", ["n"])
    got = {r["n"]: r["dialog_tag"] for r in out.collect()}
    legs = {}
    for call, n, f, t in data:
        tags = legs.setdefault(call, [])
        hit = next((tag for tag in tags if (tag in (f, t) if tag else not f)), None)
        if hit is None:
            hit = f or ""
            tags.append(hit)
        assert got[n] == hit


@pytest.mark.parametrize("jumps", [False, True])
def test_sequence_accounting(spark, jumps):
    rnd = random.Random(31)
    data, seq = [], 65400
    for n in range(600):
        roll = rnd.random()
        seq += 1 if roll < 0.85 else 3 if roll < 0.92 else 0
        sent = seq if roll < 0.96 else seq - rnd.randint(1, 20)
        if jumps and n in (200, 201, 400):
            sent = seq = seq + (20_000 if n == 200 else 1)
        data.append(("s", n, sent % 65536))
    st = media.SequenceWindow()
    for _, _, s in data:
        st.take(s)
    packets, expected, dup, ooo, resets = st.totals()
    (row,) = media.sequence_accounting(spark.createDataFrame(data, "k string, n int, seq int"), ["k"], ["n"], "seq").collect()
    assert (row["packets"], row["duplicates"], row["out_of_order"], row["resets"]) == (packets, dup, ooo, resets)
    assert row["expected"] == max(expected, packets - dup)


def test_rule_store_references(spark):
    rules = spark.createDataFrame(
        [("r1", "s", 1, "x", "modify", "$kept"), ("r2", "s", 2, "kept", "store", ""), ("r3", "s", 3, "y", "modify", "$kept"), ("r4", "s", 4, "z", "modify", "$nobody"), ("r5", "s", 5, "unused", "store", "")],
        "rule_id string, set_name string, ord int, name string, operation string, value string",
    )
    got = {(r["rule_id"], r["kind"]) for r in manip.store_references(rules).collect()}
    assert got == {("r1", "stored-later"), ("r4", "never-stored"), ("r5", "never-read")}
