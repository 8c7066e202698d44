"""Queries: pairing, as-of lookups, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.sip import digits
from sigspark.operators import linkage, matching, pairing
from sigspark.operators.ordered import epoch_us
from sigspark.plans.q_time import events
from sigspark.plans.registry import query
from sigspark.session import table

FIFO_SQL = """
    WITH b AS (SELECT event_id, user_id, ts, event_type = 'view' AS rq FROM events WHERE event_type IN ('view', 'purchase')),
    s AS (SELECT *, sum(CASE WHEN rq THEN 1 ELSE -1 END) OVER w AS s FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s),
    o AS (SELECT *, NOT rq AND s < least(0, coalesce(low, 0)) AS orphan FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, rq ORDER BY ts, event_id) AS k FROM o WHERE NOT orphan)
"""


@query(
    "fifo_pairing",
    FIFO_SQL
    + """
    SELECT q.user_id, q.event_id AS view_id, r.event_id AS purchase_id, CAST(epoch_us(r.ts) - epoch_us(q.ts) AS BIGINT) AS latency_us,
           r.event_id IS NULL AS unanswered
    FROM k q LEFT JOIN k r ON r.user_id = q.user_id AND r.k = q.k AND NOT r.rq WHERE q.rq
    """,
)
def fifo_pairing(spark, sf):
    rows = events(spark, sf).where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    out, _ = pairing.pair_fifo(rows, ["user_id"], F.col("event_type") == "view", "ts", "event_id")
    return out.select(
        "user_id", F.col("request_event_id").alias("view_id"), F.col("response_event_id").alias("purchase_id"),
        (F.unix_micros("response_ts") - F.unix_micros("request_ts")).alias("latency_us"),
        F.col("timed_out").alias("unanswered"),
    )


@query("fifo_orphans", FIFO_SQL + "SELECT event_id, user_id FROM o WHERE orphan")
def fifo_orphans(spark, sf):
    rows = events(spark, sf).where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    _, orphans = pairing.pair_fifo(rows, ["user_id"], F.col("event_type") == "view", "ts", "event_id")
    return orphans.select("event_id", "user_id")


@query(
    "named_pairing",
    """
    WITH RECURSIVE b AS (
      SELECT user_id, event_id, event_type = 'view' AS rq, lower(props) AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events WHERE event_type IN ('view', 'purchase')),
    r AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, name VARCHAR)[]) AS waiting, CAST(NULL AS BIGINT) AS view_id, CAST(NULL AS BIGINT) AS purchase_id, false AS same FROM b
      UNION ALL
      SELECT user_id, n, CASE WHEN rq THEN list_append(waiting, {'id': event_id, 'name': name}) ELSE list_filter(waiting, lambda w: w.id != hit.id OR hit.id IS NULL) END,
             CASE WHEN NOT rq THEN hit.id END, CASE WHEN NOT rq THEN event_id END, hit.name = name
      FROM (
        SELECT b.*, r.waiting, coalesce(list_filter(r.waiting, lambda w: w.name = b.name)[1], r.waiting[1]) AS hit
        FROM r JOIN b ON b.user_id = r.user_id AND b.n = r.n + 1))
    SELECT b.user_id, b.event_id AS view_id, r.purchase_id, CASE WHEN r.view_id IS NOT NULL THEN r.same END AS same_name, r.view_id IS NULL AS timed_out
    FROM b LEFT JOIN r ON r.user_id = b.user_id AND r.view_id = b.event_id WHERE b.rq
    """,
)
def named_pairing(spark, sf):
    """Views and purchases of a user, a purchase preferring an open view of the same props."""
    rows = events(spark, sf).where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type", "props")
    out, _ = pairing.pair_named(rows, ["user_id"], F.col("event_type") == "view", "ts", "event_id", "props")
    return out.select(
        "user_id", F.col("request_event_id").alias("view_id"), F.col("response_event_id").alias("purchase_id"),
        (F.col("request_props") == F.col("response_props")).alias("same_name"), "timed_out",
    )


@query(
    "asof_first_response",
    """
    SELECT v.user_id, v.event_id, p.event_id AS next_id, p.ts AS next_ts, CAST(epoch_us(p.ts) - epoch_us(v.ts) AS BIGINT) AS distance_us
    FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
)
def asof_first_response(spark, sf):
    ev = events(spark, sf)
    out = pairing.asof_next(
        ev.where("event_type = 'view'"), ev.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", "event_id", "event_id"
    )
    return out.select("user_id", "event_id", "next_id", "next_ts", "distance_us")


@query(
    "near_failures",
    """
    WITH j AS (SELECT e.user_id, e.event_id, p.event_id AS pid, abs(epoch_us(p.ts) - epoch_us(e.ts)) AS d, epoch_us(p.ts) AS pt
               FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase'
                AND p.ts BETWEEN e.ts - INTERVAL '30 minutes' AND e.ts + INTERVAL '30 minutes' WHERE e.event_type = 'error')
    SELECT user_id, event_id, count(*) AS n_near, arg_min(pid, d) AS nearest_id, CAST(min(d) AS BIGINT) AS distance_us FROM j GROUP BY 1, 2
    """,
)
def near_failures(spark, sf):
    ev = events(spark, sf)
    return pairing.near_in_time(
        ev.where("event_type = 'error'"), ev.where("event_type = 'purchase'"), 1800, ["user_id"], "ts", "ts", "event_id", "event_id"
    )


@query(
    "inside_intervals",
    """
    SELECT e.user_id, e.event_id, count(*) AS n_open
    FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND e.ts BETWEEN s.ts - INTERVAL '1 hour' AND s.ts + INTERVAL '7 hours'
    WHERE e.event_type = 'error' GROUP BY 1, 2
    """,
)
def inside_intervals(spark, sf):
    """Errors within an hour of the six hours after a signup of the same user."""
    ev = events(spark, sf)
    spans = ev.where("event_type = 'signup'").withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    out = pairing.near_intervals(
        ev.where("event_type = 'error'"), spans, 3600, ["user_id"], "ts", "event_id", "ts", "end_ts", "event_id"
    )
    return out.select("user_id", "event_id", "n_open")


@query(
    "turn_pairs",
    """
    SELECT u.conv_id, u.turn AS user_turn, min(a.turn) AS assistant_turn
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
    WHERE u.role = 'user' GROUP BY 1, 2
    """,
)
def turn_pairs(spark, sf):
    """Each user turn with the next assistant turn; turns serve as the clock."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("at", F.timestamp_micros("turn"))
    out = pairing.asof_next(
        conv.where("role = 'user'"), conv.where("role = 'assistant'"), ["conv_id"], "at", "at", "turn", "turn", strict=True
    )
    return out.select("conv_id", F.col("turn").alias("user_turn"), F.col("next_id").alias("assistant_turn"))


@query(
    "first_response_by_id",
    """
    WITH q AS (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CAST(epoch_us(q.s) - epoch_us(o_orderdate) AS BIGINT) AS rtt_us, q.s IS NULL AS unanswered
    FROM orders LEFT JOIN q ON q.l_orderkey = o_orderkey
    """,
)
def first_response_by_id(spark, sf):
    """Orders as requests, line shipments as responses of the same id: first response and delay."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tx"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(0).alias("line"), F.lit(True).alias("rq")
    )
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tx"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_linenumber").alias("line"), F.lit(False).alias("rq")
    )
    out = pairing.pair_by_id(o.unionByName(li), ["tx"], F.col("rq"), "ts", "line")
    return out.select(
        F.col("tx").alias("o_orderkey"),
        (epoch_us(F.col("response_ts")) - epoch_us(F.col("request_ts"))).alias("rtt_us"),
        F.col("response_ts").isNull().alias("unanswered"),
    )


ORDER_LINK = linkage.Linkage(
    scope=("o_custkey",),
    attributes=("priority", "status", "band"),
    signals=(
        linkage.Signal("priority", 450, lambda a, b: a["priority"] == b["priority"]),
        linkage.Signal("status", 300, lambda a, b: a["status"] == b["status"]),
        linkage.Signal("band", 100, lambda a, b: a["band"] == b["band"]),
    ),
    blocks=(
        linkage.Block(("priority", "status")),
        linkage.Block(("priority", "band")),
        linkage.Block(("priority",), near=True),
        linkage.Block(("status", "band"), near=True),
    ),
    proximity=linkage.Proximity(150, 60 * 86400 * 1_000_000),
)

PAIR_SQL = """
    WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS ord, o_orderpriority AS p, o_orderstatus AS s,
                      CAST(floor(o_totalprice / 50000) AS BIGINT) AS b FROM orders),
    j AS (SELECT x.o_custkey, x.o_orderkey AS ingress, y.o_orderkey AS egress, x.t AS t,
             CAST(floor((x.p = y.p)::INT * 450 + (x.s = y.s)::INT * 300 + (x.b = y.b)::INT * 100
               + CASE WHEN y.t - x.t < 5184000000000 THEN 150 * (5184000000000 - (y.t - x.t)) / 5184000000000.0 ELSE 0 END + 0.5) AS BIGINT) AS score
          FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND (y.t > x.t OR (y.t = x.t AND y.ord > x.ord))),
    p AS (SELECT o_custkey, ingress, egress, t, least(1000, score) AS score FROM j WHERE score >= 500),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, ingress ORDER BY score DESC, CAST(egress AS VARCHAR)) AS k FROM p),
    a AS (SELECT o_custkey, ingress, count(*) AS n_candidates, max(score) FILTER (k = 1) AS best, max(score) FILTER (k = 2) AS second FROM r GROUP BY 1, 2)
"""


def order_nodes(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderdate").alias("start_ts"),
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("ord"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 50000).cast("bigint").alias("band"),
    )


@query(
    "score_candidates",
    PAIR_SQL
    + """SELECT o_custkey, CAST(ingress AS VARCHAR) AS node_id, n_candidates, best, second FROM a""",
)
def score_candidates(spark, sf):
    nodes = linkage.with_classes(order_nodes(spark, sf), ORDER_LINK)
    ranked = linkage.rank_candidates(linkage.candidates(nodes, ORDER_LINK), ORDER_LINK)
    return ranked.select("o_custkey", "node_id", F.col("n_candidates").cast("bigint").alias("n_candidates"), "best", "second")


@query(
    "ambiguous_pairs",
    PAIR_SQL
    + """SELECT o_custkey, CAST(ingress AS VARCHAR) AS node_id, best, second FROM a WHERE best - second <= 150""",
)
def ambiguous_pairs(spark, sf):
    nodes = linkage.with_classes(order_nodes(spark, sf), ORDER_LINK)
    _, ambiguous = linkage.split_ambiguous(nodes, linkage.candidates(nodes, ORDER_LINK), ORDER_LINK)
    return ambiguous.select("o_custkey", "node_id", "best", "second")


@query(
    "scored_pool",
    PAIR_SQL
    + """SELECT p.o_custkey, CAST(p.ingress AS VARCHAR) AS ingress, CAST(p.egress AS VARCHAR) AS egress, p.score
         FROM p JOIN a USING (o_custkey, ingress) WHERE second IS NULL OR best - second > 150""",
)
def scored_pool(spark, sf):
    nodes = linkage.with_classes(order_nodes(spark, sf), ORDER_LINK)
    pool, _ = linkage.split_ambiguous(nodes, linkage.candidates(nodes, ORDER_LINK), ORDER_LINK)
    return pool.select("o_custkey", "ingress", "egress", "score")

# The pairs of the pool in the order of the sequential rule, each with the other ingress records that want its egress within the margin.
MATCH_SQL = PAIR_SQL.replace("WITH o AS", "WITH RECURSIVE o AS") + """,
    pool AS (SELECT p.* FROM p JOIN a USING (o_custkey, ingress) WHERE second IS NULL OR best - second > 150),
    e AS (
      SELECT x.o_custkey, x.ingress, x.egress, x.score, row_number() OVER (PARTITION BY x.o_custkey ORDER BY x.score DESC, x.t, CAST(x.ingress AS VARCHAR), CAST(x.egress AS VARCHAR)) AS k,
             (SELECT coalesce(list(y.ingress), []) FROM pool y WHERE y.o_custkey = x.o_custkey AND y.egress = x.egress AND y.ingress != x.ingress AND x.score - y.score <= 150) AS rivals
      FROM pool x),
    g AS (
      SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS settled, CAST(NULL AS BIGINT) AS ingress, CAST(NULL AS BIGINT) AS egress, CAST(NULL AS BIGINT) AS score, false AS taken FROM e
      UNION ALL
      SELECT o_custkey, k, CASE WHEN fine THEN list_append(used, ingress) ELSE used END, CASE WHEN free THEN list_append(settled, egress) ELSE settled END, ingress, egress, score, fine
      FROM (
        SELECT e.*, g.used, g.settled, NOT list_contains(g.used, e.ingress) AND NOT list_contains(g.settled, e.egress) AS free,
               NOT list_contains(g.used, e.ingress) AND NOT list_contains(g.settled, e.egress) AND len(list_filter(e.rivals, lambda r: NOT list_contains(g.used, r))) = 0 AS fine
        FROM g JOIN e ON e.o_custkey = g.o_custkey AND e.k = g.k + 1)),
    won AS (SELECT o_custkey, ingress, egress, score FROM g WHERE taken)
"""


@query("greedy_match", MATCH_SQL + "SELECT o_custkey, CAST(ingress AS VARCHAR) AS ingress, CAST(egress AS VARCHAR) AS egress, score FROM won")
def greedy_match(spark, sf):
    nodes = linkage.with_classes(order_nodes(spark, sf), ORDER_LINK)
    pool, _ = linkage.split_ambiguous(nodes, linkage.candidates(nodes, ORDER_LINK), ORDER_LINK)
    accepted, _ = linkage.match_greedy(pool, ["o_custkey"])
    return accepted.select("o_custkey", "ingress", "egress", "score")


@query(
    "linked_chains",
    MATCH_SQL
    + """,
    c AS (
      SELECT w.o_custkey, w.ingress AS root, w.egress AS node, w.score FROM won w WHERE NOT EXISTS (SELECT 1 FROM won b WHERE b.o_custkey = w.o_custkey AND b.egress = w.ingress)
      UNION ALL
      SELECT c.o_custkey, c.root, w.egress, w.score FROM c JOIN won w ON w.o_custkey = c.o_custkey AND w.ingress = c.node),
    chained AS (SELECT o_custkey, root, count(*) + 1 AS n_nodes, min(score) AS confidence FROM c GROUP BY 1, 2),
    inside AS (SELECT o_custkey, node FROM c UNION SELECT o_custkey, root FROM c),
    flagged AS (
      SELECT o_custkey, node, max(score) AS best
      FROM (SELECT o_custkey, ingress AS node, best AS score FROM a WHERE best - second <= 150
            UNION ALL
            SELECT n.o_custkey, n.egress, n.score
            FROM g n JOIN g b ON b.o_custkey = n.o_custkey AND b.k = n.k - 1
            WHERE len(n.settled) > len(b.settled) AND NOT n.taken)
      GROUP BY 1, 2)
    SELECT o_custkey, CAST(root AS VARCHAR) AS first_order, 'paired' AS state, n_nodes, CAST(confidence AS BIGINT) AS confidence FROM chained
    UNION ALL
    SELECT o.o_custkey, CAST(o.o_orderkey AS VARCHAR), CASE WHEN f.best IS NULL THEN 'unpaired' ELSE 'ambiguous' END, 1, CAST(coalesce(f.best, 0) AS BIGINT)
    FROM o ANTI JOIN inside i ON i.o_custkey = o.o_custkey AND i.node = o.o_orderkey LEFT JOIN flagged f ON f.o_custkey = o.o_custkey AND f.node = o.o_orderkey
    """,
)
def linked_chains(spark, sf):
    out = linkage.link(order_nodes(spark, sf), ORDER_LINK)
    return out["calls"].select("o_custkey", F.col("root").alias("first_order"), "state", "n_nodes", "confidence")


@query(
    "number_suffix",
    """
    SELECT right(c_name, 6) AS suffix, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers
    FROM customer JOIN supplier ON right(c_name, 6) = right(s_name, 6) GROUP BY 1
    """,
)
def number_suffix(spark, sf):
    """Parties whose numbers share the last six digits: grouped per side before the join."""
    c = table(spark, sf, "customer").groupBy(F.right(digits(F.col("c_name")), F.lit(6)).alias("suffix")).agg(
        F.countDistinct("c_custkey").alias("n_customers")
    )
    s = table(spark, sf, "supplier").groupBy(F.right(digits(F.col("s_name")), F.lit(6)).alias("suffix")).agg(
        F.countDistinct("s_suppkey").alias("n_suppliers")
    )
    return c.join(s, "suffix")


@query(
    "one_way",
    """
    WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey AS src, s_nationkey AS dst
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
    SELECT month, src, dst FROM f WHERE NOT EXISTS (SELECT 1 FROM f r WHERE r.month = f.month AND r.src = f.dst AND r.dst = f.src)
    """,
)
def one_way(spark, sf):
    from sigspark.operators.matching import without_reverse

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    flows = (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("month", "src", "dst").distinct()
    )
    return without_reverse(flows, ["month"], ["src"], ["dst"])


@query(
    "unmatched",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def unmatched(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti")


@query(
    "silent_after",
    """
    SELECT s.user_id, s.event_id FROM events s WHERE s.event_type = 'signup' AND NOT EXISTS
      (SELECT 1 FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL '1 day')
    """,
)
def silent_after(spark, sf):
    from sigspark.operators.matching import silent_after as silent

    ev = events(spark, sf)
    return silent(
        ev.where("event_type = 'signup'"), ev.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", "event_id", "event_id", 86400
    ).select("user_id", "event_id")


@query(
    "contained_phrases",
    r"""
    WITH n AS (
      SELECT DISTINCT lang, array_to_string(w[i + 1:i + 4], ' ') AS phrase
      FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w, unnest([0, 4, 8]) AS i FROM benchmark), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
      WHERE length(array_to_string(w[i + 1:i + 4], ' ')) >= 12)
    SELECT DISTINCT n.lang, phrase, md5(text) AS text_md5 FROM n JOIN documents d ON d.lang = n.lang AND contains(d.text, n.phrase)
    """,
)
def contained_phrases(spark, sf):
    """Phrases of four words from benchmark items that occur in documents of a language."""
    docs = table(spark, sf, "documents")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    cut = table(spark, sf, "benchmark").select(words.alias("w")).select(F.explode(F.array(*[F.array_join(F.slice("w", i + 1, 4), " ") for i in (0, 4, 8)])).alias("phrase"))
    scopes = docs.where("lang IS NOT NULL").select(F.col("lang").alias("capture_id")).distinct()
    # every phrase is asked in each of the few languages
    needles = cut.distinct().withColumn("capture_id", F.explode(F.array([F.lit(r[0]) for r in scopes.collect()])))
    found = matching.match_containment(needles, docs.select(F.col("lang").alias("capture_id"), "text"), "phrase", "text", 12)
    return found.select(F.col("capture_id").alias("lang"), "phrase", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
