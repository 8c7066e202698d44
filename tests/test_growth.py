"""Work that must grow with the input only: rows made on the way, and the same results."""

import random

from pyspark.sql import functions as F

from sigspark.operators import manip


def test_rules_meet_kinds_of_calls_and_no_changes(spark, monkeypatch):
    rng = random.Random(3)
    tags, headers = ["t1", "t2", "t3", None], ["from", "to", None]
    items = [(rng.choice(tags), rng.choice(headers), rng.choice([*range(40), None])) for _ in range(150)]
    rules = [(f"r{i % 14}", rng.choice(["From", "TO", "via", None]), rng.choice([["t1"], ["t1", "t3"], ["t2", "no"], ["no", None], [], None])) for i in range(20)]
    rules += [(None, None, ["t1"]), ("only-null-call", "x-y", ["t9"])]
    items += [("t9", "x-y", None), ("t8", "x-z", 1), ("t8", "x-z", 2), ("t8", None, None)]
    staged = []
    stage = manip.stage
    monkeypatch.setattr(manip, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    frames = spark.createDataFrame(rules, "rule_id string, header string, expected array<string>"), spark.createDataFrame(items, "tag string, header string, call_no int")
    got = manip.rules_vs_changes(*frames, tags=["t1", "t2", "t3", "t8"]).collect()

    want, explained, seen = [], set(), {}
    for rule, header, expected in rules:
        for tag, h, call in items:
            if tag is not None and tag in (expected or []) and (h is None or (header and h == header.lower())):
                explained.add((tag, h))
                calls, found = seen.setdefault(rule, (set(), set()))
                found.add(tag)
                calls.update([call] if call is not None else [])
    want += [(r, "observed-as-configured", len(c), ",".join(sorted(f)), None) for r, (c, f) in seen.items()]
    want += [(r, "configured-not-observed", 0, "", None) for r, *_ in rules if r not in seen or r is None]
    for tag, h in {(t, h) for t, h, _ in items if t in ("t1", "t2", "t3", "t8")} - explained:
        want.append((None, "observed-not-configured", len({c for t, x, c in items if (t, x) == (tag, h) and c is not None}), tag, h))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # one table of kinds of calls, with no more rows than there are calls
    assert len(staged) == 1 and staged[0].count() <= 41


def test_changes_are_joined_with_no_rule(spark):
    rules = spark.range(200).select(F.col("id").cast("string").alias("rule_id"), F.lit(None).cast("string").alias("header"), F.array(F.lit("a"), F.lit("b")).alias("expected"))
    items = spark.range(5_000).select(F.lit("a").alias("tag"), F.lit(None).cast("string").alias("header"), F.col("id").alias("call_no"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = items.mapInArrow(count, items.schema)
    out = manip.rules_vs_changes(rules, counted).collect()
    assert {(r.verdict, r.n_calls) for r in out} == {("observed-as-configured", 5_000)} and len(out) == 200
    assert reads.value == 5_000


RULE = "rule_id string, set_name string, ord long, operation string, target_header string, target_element string, msg_type string, methods array<string>"


def test_conflicts_of_rules_equal_comparing_all(spark):
    rng = random.Random(5)
    rules = [
        (f"r{i}", rng.choice(["s1", "s2", None]), rng.randrange(30), rng.choice(["add", "add", "delete", "modify", "store"]), rng.choice(["To", "f"]), rng.choice([None, "uri"]),
         rng.choice(["any", "request", "response", None]), rng.choice([None, [], ["A"], ["A", "B"], ["B", "C"], ["A", "A"]])) for i in range(120)
    ]
    got = manip.write_conflicts(spark.createDataFrame(rules, RULE)).select("set_name", "rule_id", "other_id", "severity", "other_wins").collect()
    want = []
    for a in rules:
        met = []
        for b in rules:
            types = a[6] in ("any", None) or b[6] in ("any", None) or a[6] == b[6]
            methods = not a[7] or not b[7] or set(a[7]) & set(b[7])
            if a[0] != b[0] and a[1] and a[1] == b[1] and a[4:5] + ((a[5] or ""),) == b[4:5] + ((b[5] or ""),) and "store" not in (a[3], b[3]) and (a[3], b[3]) != ("add", "add") and types and methods:
                met.append((b[2], b[0], b[3]))
        if met:
            o = min(met)
            want.append((a[1], a[0], o[1], "warn" if "delete" in (a[3], o[2]) else "notice", o[0] > a[2]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_rules_alike_enter_once(spark, monkeypatch):
    rules = spark.range(900).selectExpr("cast(id as string) rule_id", "'s' set_name", "id ord", "'modify' operation", "'To' target_header", "null target_element", "'request' msg_type", "array('A', 'B') methods")
    rows, two_first = [], manip._two_first
    monkeypatch.setattr(manip, "_two_first", lambda df, keys: rows.append(df.count()) or two_first(df, keys))
    out = manip.write_conflicts(rules).collect()
    assert len(out) == 900 and {r.other_id for r in out} == {"0", "1"}
    # each rule once, and then the two first of them in 12 groups
    assert rows == [900, 24]


def test_small_scopes_are_compared_in_place_with_the_same_candidates(spark, monkeypatch):
    from sigspark.operators import linkage

    rng = random.Random(11)
    rows = []
    for scope in [*range(30), None]:
        for i in range(90 if scope == 4 else rng.randint(1, 14)):
            t = rng.choice([None, *[rng.randrange(0, 400) for _ in range(12)]])
            rows.append((scope, f"n{i}", t, f"{rng.randrange(90):03d}", rng.choice("abc"), rng.choice("xy"), rng.choice([None, "p", "q"]), rng.choice([None, [], ["u"], ["u", "v"], ["w"]])))
    rows += rng.sample(rows, 25)  # rows that come twice
    nodes = spark.createDataFrame(rows, "g int, node_id string, s long, ord string, p string, q string, r string, ids array<string>")
    nodes = nodes.withColumn("start_ts", F.timestamp_seconds("s")).drop("s")
    same = lambda c: lambda a, b: a[c] == b[c]
    spec = linkage.Linkage(
        scope=("g",), attributes=("p", "q", "r", "ids"),
        signals=(linkage.Signal("p", 450, same("p")), linkage.Signal("q", 300, same("q")), linkage.Signal("r", 100, same("r")), linkage.Signal("ids", 520, lambda a, b: F.arrays_overlap(a["ids"], b["ids"]))),
        blocks=(linkage.Block(("p", "q"), right_if=lambda a: a["r"] == "p"), linkage.Block(("p",), near=True), linkage.Block(("ids",)), linkage.Block(("q", "r"), near=True)),
        proximity=linkage.Proximity(150, 60_000_000),
    )
    calls, by_class = [], linkage._candidates_by_class
    monkeypatch.setattr(linkage, "_candidates_by_class", lambda n, *a: calls.append({r.g for r in n.select("g").distinct().collect()}) or by_class(n, *a))
    classed = linkage.with_classes(nodes, spec)
    found = {}
    for limit in ("0", "64"):
        spark.conf.set("spark.sigspark.maxScopeRecords", limit)
        try:
            found[limit] = sorted(map(tuple, linkage.candidates(classed, spec).collect()), key=repr)
        finally:
            spark.conf.unset("spark.sigspark.maxScopeRecords")
    assert found["0"] == found["64"] and len(found["0"]) > 200
    # only the large scope goes through blocks and classes
    assert calls[1] == {4}


def test_items_are_kept_apart_in_parts_by_their_count(spark, monkeypatch):
    from sigspark.operators import rowdiff

    rng = random.Random(2)
    rows = [("s", rng.choice(["t", "u"]), "l", rng.choice(["a", None]), rng.choice(["b", "c"]), rng.choice([*range(9), None]), rng.choice([*range(5), None])) for _ in range(300)]
    items = spark.createDataFrame(rows, "severity string, tag string, label string, ingress_value string, egress_value string, call int, line int")
    monkeypatch.setattr(rowdiff, "ITEMS_PER_TASK", 7)
    out = rowdiff.group_items(items, ["severity"], "call", "line", 3)
    key = lambda r: (r[0], r[1], r[3], r[4])
    want = {}
    for r in rows:
        calls, lines, n = want.setdefault(key(r), (set(), set(), []))
        n.append(1), calls.add(r[5]), lines.add(r[6])
    for g in out.collect():
        calls, lines, n = want.pop((g.severity, g.tag, g.ingress_value, g.egress_value))
        first = sorted(lines, key=lambda x: (x is not None, x))[:3]
        assert (g.n_calls, g.n_items, g["sample"]) == (len(calls - {None}), len(n), [x for x in first if x is not None])
    assert not want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "43" in [w for line in plan.splitlines() if "RepartitionByExpression" in line for w in line.replace(",", " ").split()]


def test_query_terms_come_to_chunks_with_the_same_scores(spark):
    from sigspark.operators import textindex

    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "pi"]) for _ in range(n))
    texts = spark.createDataFrame([(i, say(rng.randint(0, 30)), say(2)) for i in [*range(40), 3, 7]], "id int, body string, heading string")
    asked = spark.createDataFrame([(f"q{i}", say(3)) for i in range(12)] + [("q3", "alpha tau"), ("none", "zz"), (None, "pi")], "q string, text string")
    index = textindex.build_index(texts, ["id"], F.col("body"), F.col("heading"))
    got = {}
    for rows in ("200000", "3"):
        spark.conf.set("spark.sigspark.maxBroadcastRows", rows)
        try:
            hits = textindex.bm25(index, asked, "q", F.col("text"), ["id"])
            got[rows] = sorted(map(tuple, hits.collect()))
            plan = hits._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("spark.sigspark.maxBroadcastRows")
        # the sums of a query are not joined with its number of terms
        assert plan.count("Join") == (1 if rows == "200000" else 2)
    assert got["3"] == got["200000"] and {r[0] for r in got["3"]} == {f"q{i}" for i in range(12)}
