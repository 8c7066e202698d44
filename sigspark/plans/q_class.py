"""Queries: diffs, rules, facts, labels, indicators, rollups, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.quality import estimate_mos
from sigspark.operators import classify, manip, media, rollups, rowdiff
from sigspark.operators.ordered import peak_concurrency
from sigspark.plans.q_time import events
from sigspark.operators.labels import label_texts, rule_table
from sigspark.plans.profile_sip import VENDOR_RULES
from sigspark.plans.registry import query
from sigspark.plans.slices import lead, scan, top_per
from sigspark.session import spread, table

# ---- diff of adjacent order lines -----------------------------------------------------------------

LINE_SQL = """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_linestatus AS s, l_suppkey AS k, l_quantity AS q, l_discount AS d, l_tax AS t, l_partkey AS p
               FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
    n AS (SELECT *, lead(l_linenumber) OVER w AS n2, lead(f) OVER w AS f2, lead(s) OVER w AS s2, lead(k) OVER w AS k2, lead(q) OVER w AS q2, lead(d) OVER w AS d2
          FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    i AS (
      SELECT l_orderkey, l_linenumber, 'flag-rewritten' AS tag, 'notice' AS severity, f AS ingress, f2 AS egress FROM n WHERE n2 IS NOT NULL AND f <> f2
      UNION ALL SELECT l_orderkey, l_linenumber, 'status-rewritten', 'warn', s, s2 FROM n WHERE n2 IS NOT NULL AND s <> s2
      UNION ALL SELECT l_orderkey, l_linenumber, 'supplier-changed', 'info', CAST(k AS VARCHAR), CAST(k2 AS VARCHAR) FROM n WHERE n2 IS NOT NULL AND k <> k2
      UNION ALL SELECT l_orderkey, l_linenumber, 'quantity-narrowed', 'info', CAST(CAST(q AS BIGINT) AS VARCHAR), CAST(CAST(q2 AS BIGINT) AS VARCHAR) FROM n WHERE n2 IS NOT NULL AND q2 < q
      UNION ALL SELECT l_orderkey, l_linenumber, 'discount-conflict', CASE WHEN d2 - d > 0.05 THEN 'warn' ELSE 'notice' END, NULL, NULL FROM n WHERE n2 IS NOT NULL AND d2 > d)
"""

LINE_COMPARATORS = (
    rowdiff.when_differs("flag-rewritten", "notice", "flags", "flag changed", lambda a, b: a["flag"] != b["flag"], lambda a, b: a["flag"], lambda a, b: b["flag"]),
    rowdiff.when_differs("status-rewritten", "warn", "flags", "status changed", lambda a, b: a["status"] != b["status"], lambda a, b: a["status"], lambda a, b: b["status"]),
    rowdiff.when_differs("supplier-changed", "info", "party", "supplier changed", lambda a, b: a["supp"] != b["supp"], lambda a, b: a["supp"], lambda a, b: b["supp"]),
    rowdiff.when_differs("quantity-narrowed", "info", "amount", "smaller quantity", lambda a, b: b["qty"] < a["qty"], lambda a, b: a["qty"], lambda a, b: b["qty"]),
    rowdiff.when_differs(
        "discount-conflict", lambda a, b: F.when(b["disc"] - a["disc"] > 0.05, "warn").otherwise("notice"), "amount", "larger discount",
        lambda a, b: b["disc"] > a["disc"], lambda a, b: F.lit(None), lambda a, b: F.lit(None),
    ),
)


def line_rows(spark, sf):
    """One row per order line number (the first by content where the data repeats one)."""
    li = table(spark, sf, "lineitem")
    row = F.struct(
        "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_discount").alias("disc"),
    )
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min(row).alias("r")).select(
        "l_orderkey", "l_linenumber", "r.flag", "r.status", F.col("r.l_suppkey").alias("supp"), "r.qty", "r.disc"
    )


def line_items(spark, sf):
    rows = line_rows(spark, sf)
    fields = F.struct("l_linenumber", "flag", "status", "supp", "qty", "disc")
    paired = scan(rows, ["l_orderkey"], ["l_linenumber"], {"_r": lead(fields)}).where(F.col("_r").isNotNull())
    # both sides of the pair lie in one row already, so the comparators run without a join
    left, right = F.struct("flag", "status", "supp", "qty", "disc"), F.col("_r")
    empty = F.array().cast(f"array<{rowdiff.ITEM}>")
    items = F.flatten(F.array(*[F.coalesce(c.build(left, right).cast(f"array<{rowdiff.ITEM}>"), empty) for c in LINE_COMPARATORS]))
    return paired.select("l_orderkey", "l_linenumber", F.explode(items).alias("i")).select("l_orderkey", "l_linenumber", "i.*")


@query("rowdiff_items", LINE_SQL + "SELECT l_orderkey, l_linenumber, tag, severity, ingress, egress FROM i")
def rowdiff_items(spark, sf):
    return line_items(spark, sf).select("l_orderkey", "l_linenumber", "tag", "severity", "ingress", "egress")


@query("diff_groups", LINE_SQL + "SELECT tag, severity, count(*) AS n_items, count(DISTINCT l_orderkey) AS n_orders FROM i GROUP BY 1, 2")
def diff_groups(spark, sf):
    return line_items(spark, sf).groupBy("tag", "severity").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("l_orderkey").alias("n_orders")
    )


@query(
    "diff_promoted",
    LINE_SQL + "SELECT l_orderkey, l_linenumber, tag, coalesce('ingress: ' || ingress, '') || coalesce(' | egress: ' || egress, '') AS detail FROM i WHERE severity IN ('warn', 'crit')",
)
def diff_promoted(spark, sf):
    items = line_items(spark, sf).withColumnRenamed("ingress", "ingress_value").withColumnRenamed("egress", "egress_value")
    return rowdiff.promote(items).select("l_orderkey", "l_linenumber", "tag", "detail")


@query(
    "set_difference",
    """
    WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value < 50))) AS a, list_sort(list_distinct(list(event_type) FILTER (value >= 50))) AS b FROM events GROUP BY 1)
    SELECT user_id, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))) AS n_removed, len(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x))) AS n_added FROM s
    """,
)
def set_difference(spark, sf):
    """Event types of a user's small against large values: sets of at most five names."""
    small = F.col("value") < 50
    s = events(spark, sf).groupBy("user_id").agg(
        F.collect_set(F.when(small, F.col("event_type"))).alias("a"), F.collect_set(F.when(~small, F.col("event_type"))).alias("b")
    )
    d = rowdiff.diff_sets(F.col("a"), F.col("b"))
    return s.select("user_id", F.size(d["removed"]).cast("bigint").alias("n_removed"), F.size(d["added"]).cast("bigint").alias("n_added"))


# ---- rules ---------------------------------------------------------------------------------------


RULE_SQL = """
    WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_brand || p_name AS set_name, p_partkey AS ord,
        CASE p_size % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' WHEN 2 THEN 'modify' ELSE 'replace' END AS op, lower(p_type) AS h,
        CASE p_size % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'request' ELSE 'response' END AS ty,
        CASE WHEN p_size % 5 = 0 THEN [] WHEN p_size % 5 < 3 THEN ['INVITE', 'BYE'] ELSE ['REGISTER', 'BYE'] END AS ms FROM part)
"""


def part_rules(spark, sf):
    """Parts read as header rules: brand and name are the set, type the header, size the rest."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    size = F.col("p_size")
    methods = F.when(size % 5 == 0, F.array().cast("array<string>")).when(size % 5 < 3, F.array(F.lit("INVITE"), F.lit("BYE"))).otherwise(F.array(F.lit("REGISTER"), F.lit("BYE")))
    return p.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.concat("p_brand", "p_name").alias("set_name"), F.col("p_partkey").alias("ord"),
        F.when(size % 4 == 0, "add").when(size % 4 == 1, "delete").when(size % 4 == 2, "modify").otherwise("replace").alias("operation"),
        F.lower("p_type").alias("target_header"), F.lit(None).cast("string").alias("target_element"),
        F.when(size % 3 == 0, "any").when(size % 3 == 1, "request").otherwise("response").alias("msg_type"), methods.alias("methods"),
    )


@query(
    "write_conflicts",
    RULE_SQL
    + """
    , j AS (SELECT a.set_name, a.rule_id, a.ord, a.op, b.rule_id AS other_id, b.ord AS oo, b.op AS bop,
              row_number() OVER (PARTITION BY a.rule_id ORDER BY b.ord, b.rule_id) AS k
            FROM r a JOIN r b ON a.set_name = b.set_name AND a.h = b.h AND a.rule_id <> b.rule_id AND NOT (a.op = 'add' AND b.op = 'add')
             AND (a.ty = 'any' OR b.ty = 'any' OR a.ty = b.ty) AND (len(a.ms) = 0 OR len(b.ms) = 0 OR list_has_any(a.ms, b.ms)))
    SELECT set_name, rule_id, other_id, CASE WHEN op = 'delete' OR bop = 'delete' THEN 'warn' ELSE 'notice' END AS severity, oo > ord AS other_wins FROM j WHERE k = 1
    """,
)
def write_conflicts(spark, sf):
    return manip.write_conflicts(part_rules(spark, sf)).select("set_name", "rule_id", "other_id", "severity", "other_wins")


@query(
    "delete_then_add",
    RULE_SQL
    + """
    SELECT a.set_name, a.rule_id, (SELECT b.rule_id FROM r b WHERE b.set_name = a.set_name AND b.h = a.h AND b.op = CASE a.op WHEN 'add' THEN 'delete' ELSE 'add' END ORDER BY b.ord LIMIT 1) AS other_id
    FROM r a WHERE a.op IN ('add', 'delete') AND EXISTS (SELECT 1 FROM r b WHERE b.set_name = a.set_name AND b.h = a.h AND b.op = CASE a.op WHEN 'add' THEN 'delete' ELSE 'add' END)
    """,
)
def delete_then_add(spark, sf):
    return manip.delete_then_add(part_rules(spark, sf)).select("set_name", "rule_id", "other_id")


@query(
    "rules_vs_observed",
    LINE_SQL
    + """
    , w AS (SELECT p_brand AS rule_id, CASE WHEN count(*) FILTER (p_size > 48) >= 3 THEN 'flag-rewritten' WHEN count(*) FILTER (p_size > 48) = 2 THEN 'quantity-narrowed' ELSE 'never-seen' END AS tag FROM part GROUP BY 1),
    o AS (SELECT tag, count(DISTINCT l_orderkey) AS n FROM i GROUP BY 1)
    SELECT w.rule_id, CASE WHEN o.n IS NULL THEN 'configured-not-observed' ELSE 'observed-as-configured' END AS verdict, coalesce(o.n, 0) AS n_calls FROM w LEFT JOIN o USING (tag)
    UNION ALL SELECT NULL, 'observed-not-configured', o.n FROM o WHERE o.tag IN ('status-rewritten', 'supplier-changed', 'discount-conflict', 'flag-rewritten', 'quantity-narrowed') AND o.tag NOT IN (SELECT tag FROM w)
    """,
)
def rules_vs_observed(spark, sf):
    """Brands read as rules that expect a change; the order lines show which changes there are."""
    big = F.count_if(F.col("p_size") > 48)
    rules = table(spark, sf, "part").groupBy(F.col("p_brand").alias("rule_id")).agg(big.alias("n")).select(
        "rule_id", F.lit(None).cast("string").alias("header"),
        F.array(F.when(F.col("n") >= 3, "flag-rewritten").when(F.col("n") == 2, "quantity-narrowed").otherwise("never-seen")).alias("expected"),
    )
    items = line_items(spark, sf).select("tag", F.lit(None).cast("string").alias("header"), F.col("l_orderkey").alias("call_no"))
    out = manip.rules_vs_changes(rules, items, tags=[c.tag for c in LINE_COMPARATORS])
    return out.select("rule_id", "verdict", "n_calls")


# ---- media-like counters on order lines --------------------------------------------------------------


@query(
    "seq_accounting",
    """
    WITH n AS (SELECT l_orderkey, count(*) AS packets, max(l_linenumber) - min(l_linenumber) + 1 AS span, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1)
    SELECT l_orderkey, packets, CAST(greatest(span, k) AS BIGINT) AS expected, packets - k AS duplicates, CAST(greatest(0, span - k) AS BIGINT) AS lost FROM n
    """,
)
def seq_accounting(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    out = media.sequence_accounting(li, ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_partkey"], "l_linenumber")
    return out.select("l_orderkey", "packets", F.col("expected").cast("bigint").alias("expected"), "duplicates", "lost")


MOS_CODECS = {"Brand#1": "PCMU", "Brand#2": "G729", "Brand#3": "OPUS"}


@query(
    "mos_estimate",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 100 AS loss, l_quantity AS jit,
                 CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 11 WHEN 'Brand#3' THEN 5 ELSE 0 END AS ie, CASE p_brand WHEN 'Brand#1' THEN 4.3 WHEN 'Brand#2' THEN 19 ELSE 10 END AS bpl
               FROM lineitem JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, 93.2 - (0.024 * (30 + 2 * jit) + CASE WHEN 30 + 2 * jit > 177.3 THEN 0.11 * (30 + 2 * jit - 177.3) ELSE 0 END) - (ie + (95 - ie) * (loss / (loss + bpl))) AS r FROM x),
    m AS (SELECT *, greatest(1, least(4.5, CASE WHEN r < 0 THEN 1 WHEN r > 100 THEN 4.5 ELSE 1 + 0.035 * r + r * (r - 60) * (100 - r) * 0.000007 END)) AS mos FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(floor(mos * 100 + 0.5) / 100 AS DOUBLE), 2) AS mos FROM m
    """,
)
def mos_estimate(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    codec = F.lit("unknown")
    for brand, name in MOS_CODECS.items():
        codec = F.when(F.col("p_brand") == brand, name).otherwise(codec)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), codec.alias("codec"))
    mos = estimate_mos(F.col("l_discount") * 100, F.col("l_quantity"), F.col("codec"))
    return li.join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(mos, 2).alias("mos"))


# ---- facts, labels, indicators -------------------------------------------------------------------


USER_FACTS_SQL = """
    WITH f AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_err, count(*) FILTER (event_type = 'purchase') AS n_buy, count(*) FILTER (event_type = 'signup') AS n_sign,
                 count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, max(value) AS top FROM events GROUP BY 1)
"""


def user_facts(spark, sf):
    kind = F.col("event_type")
    return events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "error").alias("n_err"), F.count_if(kind == "purchase").alias("n_buy"), F.count_if(kind == "signup").alias("n_sign"),
        F.count_if(kind == "view").alias("n_view"), F.count_if(kind == "click").alias("n_click"), F.max("value").alias("top"),
    )


def user_tests():
    n, err, buy, view, click = (F.col(c) for c in ("n", "n_err", "n_buy", "n_view", "n_click"))
    return [
        classify.Test("buyer", "many purchases", 350, buy * 5 >= n), classify.Test("buyer", "more than views", 250, buy > view),
        classify.Test("browser", "many views", 350, view * 5 >= n), classify.Test("browser", "clicks", 250, click > buy),
        classify.Test("troubled", "many errors", 400, err * 5 >= n), classify.Test("troubled", "errors over purchases", 200, err > buy),
    ]


@query(
    "scenario_score",
    USER_FACTS_SQL
    + """
    , s AS (SELECT user_id, unnest([{'l': 'buyer', 'o': 0, 's': (n_buy * 5 >= n)::INT * 350 + (n_buy > n_view)::INT * 250}, {'l': 'browser', 'o': 1, 's': (n_view * 5 >= n)::INT * 350 + (n_click > n_buy)::INT * 250},
                                    {'l': 'troubled', 'o': 2, 's': (n_err * 5 >= n)::INT * 400 + (n_err > n_buy)::INT * 200}]) AS x FROM f),
    r AS (SELECT user_id, x.l AS l, x.s AS s, row_number() OVER (PARTITION BY user_id ORDER BY x.s DESC, x.o) AS k FROM s),
    t AS (SELECT user_id, max(l) FILTER (k = 1) AS l, max(s) FILTER (k = 1) AS a, max(s) FILTER (k = 2) AS b FROM r GROUP BY 1)
    SELECT user_id, CASE WHEN a < 350 THEN 'unknown' ELSE l END AS label,
           CAST(CASE WHEN a < 350 THEN least(300, a) WHEN a - b < 100 THEN greatest(300, least(950, a) - 150) ELSE least(950, a) END AS BIGINT) AS confidence FROM t
    """,
)
def scenario_score(spark, sf):
    return classify.score_labels(user_facts(spark, sf), ["user_id"], user_tests()).select("user_id", "label", "confidence")


@query(
    "indicators",
    USER_FACTS_SQL
    + """
    , k AS (SELECT unnest(['buying', 'errors', 'signup']) AS key)
    SELECT user_id, key, CASE key WHEN 'buying' THEN CASE WHEN n_buy * 20 < n THEN 'issue' WHEN n_buy > 0 THEN 'on' WHEN n_view > 0 THEN 'partial' ELSE 'off' END
      WHEN 'errors' THEN CASE WHEN n_err * 4 >= n THEN 'issue' WHEN n_err > 0 THEN 'on' ELSE 'off' END ELSE CASE WHEN n_sign >= 10 THEN 'on' WHEN n_sign > 0 THEN 'partial' ELSE 'off' END END AS state FROM f, k
    """,
)
def indicators(spark, sf):
    n, err, buy, sign, view = (F.col(c) for c in ("n", "n_err", "n_buy", "n_sign", "n_view"))
    spec = [
        classify.Indicator("buying", buy > 0, partial=view > 0, issue=buy * 20 < n),
        classify.Indicator("errors", err > 0, issue=err * 4 >= n),
        classify.Indicator("signup", sign >= 10, partial=sign > 0),
    ]
    return classify.indicators(user_facts(spark, sf), ["user_id"], spec).select("user_id", "key", "state")


@query(
    "rule_topk",
    """
    WITH m AS (SELECT user_id, 'slow' AS rule_id, 'warn' AS severity, 0 AS no, CAST(event_id AS VARCHAR) AS e FROM events WHERE value > 90
               UNION ALL SELECT user_id, 'failing', 'crit', 1, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id, rule_id ORDER BY e) AS k FROM m),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'crit' THEN 0 ELSE 1 END, no, e) AS rank FROM a WHERE k <= 8)
    SELECT user_id, rule_id, severity, e AS evidence, CAST(rank AS INT) AS rank FROM b WHERE rank <= 12
    """,
)
def rule_topk(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "event_type", "value")
    rules = [
        classify.Rule("slow", "warn", lambda: ev.where("value > 90"), F.col("event_id")),
        classify.Rule("failing", "crit", lambda: ev.where("event_type = 'error'"), F.col("event_id")),
    ]
    advice, _ = classify.run_rules(rules, ["user_id"], per_rule=8, total=12)
    return advice.select("user_id", "rule_id", "severity", "evidence", "rank")


@query(
    "severity_rollup",
    """
    WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'crit' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'notice' ELSE 'info' END AS sev, event_type IN ('error', 'signup') AS f FROM events)
    SELECT user_id, count(*) FILTER (sev = 'crit') AS crit, count(*) FILTER (sev = 'warn') AS warn, count(*) FILTER (sev = 'notice') AS notice, count(*) FILTER (sev = 'info') AS info,
           arg_min(sev, (CASE WHEN f THEN 0 ELSE 10 END) + CASE sev WHEN 'crit' THEN 0 WHEN 'warn' THEN 1 WHEN 'notice' THEN 2 ELSE 3 END) AS worst FROM s GROUP BY 1
    """,
)
def severity_rollup(spark, sf):
    kind = F.col("event_type")
    sev = F.when(kind == "error", "crit").when(kind == "purchase", "warn").when(kind == "signup", "notice").otherwise("info")
    ids = events(spark, sf).select("user_id", sev.alias("severity"), F.when(kind.isin("error", "signup"), "finding").otherwise("advice").alias("source"))
    worst = classify.worst_severity(ids, ["user_id"]).select("user_id", F.col("severity").alias("worst"))
    return rollups.count_by(ids, ["user_id"], "severity", rollups.SEVERITIES).join(worst, "user_id")


@query(
    "facts",
    """
    WITH o AS (SELECT c_mktsegment AS seg, o_orderkey, o_totalprice, o_orderstatus, o_custkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT seg, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY seg ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY seg) AS n FROM o),
    m AS (SELECT seg, cents FROM r WHERE k = n // 2 + 1),
    t AS (SELECT seg, max(c) AS top, sum(c) AS total FROM (SELECT seg, o_custkey, count(*) AS c FROM o GROUP BY 1, 2) GROUP BY 1)
    SELECT o.seg AS segment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, any_value(m.cents) AS median_cents,
           CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5) AS BIGINT) AS failed_pct, any_value(t.top) AS top_customer_orders
    FROM o JOIN m ON m.seg = o.seg JOIN t ON t.seg = o.seg GROUP BY 1
    """,
)
def facts(spark, sf):
    """One facts row per market segment: counts, upper median, shares; each part its own aggregate."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").join(c, "o_custkey")
    base = o.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"),
        rollups.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("failed_pct"),
    )
    median = rollups.upper_median(o, ["segment"], "o_totalprice", ["o_orderkey"])
    top = o.groupBy("segment", "o_custkey").count().groupBy("segment").agg(F.max("count").alias("top_customer_orders"))
    out = base.join(median, "segment").join(top, "segment")
    return out.withColumn("median_cents", F.round(F.col("upper_median") * 100).cast("bigint")).drop("upper_median")


@query(
    "upper_median",
    """
    WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, o_totalprice AS upper_median FROM r WHERE k = n // 2 + 1
    """,
)
def upper_median(spark, sf):
    return rollups.upper_median(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"])


@query(
    "common_prefix",
    """
    WITH e AS (SELECT c_nationkey, min(c_name) AS a, max(c_name) AS b FROM customer GROUP BY 1)
    SELECT c_nationkey, left(a, CAST(len(list_filter(range(1, length(a) + 1), lambda i: left(a, CAST(i AS INT)) = left(b, CAST(i AS INT)))) AS INT)) AS prefix FROM e
    """,
)
def common_prefix(spark, sf):
    return rollups.common_prefix(table(spark, sf, "customer"), ["c_nationkey"], F.col("c_name"))


@query(
    "segment_peak",
    """
    WITH i AS (SELECT c_mktsegment AS g, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 7 * 86400000000 + 1 AS e FROM orders JOIN customer ON c_custkey = o_custkey),
    d AS (SELECT g, t, d, count(*) AS n FROM (SELECT g, s AS t, 1 AS d FROM i UNION ALL SELECT g, e, -1 FROM i) GROUP BY 1, 2, 3),
    r AS (SELECT g, t, sum(d * n) OVER (PARTITION BY g ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM d)
    SELECT g AS segment, CAST(max(open) AS BIGINT) AS peak FROM r GROUP BY 1
    """,
)
def segment_peak(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("s")).join(c, "o_custkey")
    o = o.withColumn("e", F.col("s") + F.expr("INTERVAL 7 DAYS"))
    return peak_concurrency(o, "s", "e", ["segment"]).select("segment", "peak")


# ---- product figures --------------------------------------------------------------------------------


@query(
    "traffic_daily",
    """
    SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS bots, count(*) FILTER (event_type <> 'error') AS humans,
           count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS css_hits,
           count(DISTINCT user_id) FILTER (event_type <> 'error') AS networks,
           CAST(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN floor(100.0 * count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') + 0.5) END AS BIGINT) AS css_ratio
    FROM events GROUP BY 1
    """,
)
def traffic_daily(spark, sf):
    """Events read as access-log rows: errors are crawlers, clicks style sheets, views pages."""
    kind = F.col("event_type")
    log = events(spark, sf).select(
        F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("ip"),
        F.when(kind == "click", "/a.css").when(kind == "view", "/page").otherwise("/a.js").alias("path"), F.when(kind == "error", "some bot").otherwise("").alias("ua"),
    )
    return rollups.traffic(log, ["day"]).select("day", "requests", "bots", "humans", "views", "css_hits", "networks", "css_ratio")


@query(
    "top_paths",
    """
    WITH v AS (SELECT url_path AS path, count(*) AS views FROM (SELECT split_part(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '?', 1) AS url_path FROM pages) GROUP BY 1)
    SELECT path, views FROM v ORDER BY views DESC, path LIMIT 8
    """,
)
def top_paths(spark, sf):
    log = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1).alias("path"), F.lit("").alias("ua"))
    return rollups.top_paths(log)


@query(
    "kpi_activation",
    """
    SELECT count(*) AS users, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS activated, count(*) FILTER (c_acctbal > 5000) AS paid,
           CAST(floor(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) / count(*) + 0.5) AS BIGINT) AS activation_pct,
           CAST(floor(100.0 * count(*) FILTER (c_acctbal > 5000) / count(*) + 0.5) AS BIGINT) AS conversion_pct FROM customer
    """,
)
def kpi_activation(spark, sf):
    stamp = F.lit(None).cast("timestamp")
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "paid").otherwise("free").alias("plan"), stamp.alias("created_at"), stamp.alias("last_login_at")
    )
    captures = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("uploaded_at"))
    return rollups.kpis(users, captures, F.current_timestamp()).select("users", "activated", "paid", "activation_pct", "conversion_pct")


@query(
    "weekly_digest",
    """
    SELECT strftime(ts, '%G-W%V') AS week, event_type AS kind, count(*) AS n, count(*) FILTER (value >= 50) AS n_rated FROM events GROUP BY 1, 2
    """,
)
def weekly_digest(spark, sf):
    fb = events(spark, sf).select("ts", F.col("event_type").alias("kind"), F.when(F.col("value") >= 50, F.col("value")).alias("rating"))
    return rollups.weekly_digest(fb).select("week", "kind", "n", "n_rated")


@query(
    "retention_plan",
    """
    WITH a AS (SELECT o_orderpriority, CAST(floor((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS age FROM orders)
    SELECT o_orderpriority, CASE WHEN age IS NULL THEN 'skipped-undated' WHEN age <= 1000 THEN 'keep' ELSE 'remove' END AS fate, count(*) AS n FROM a GROUP BY 1, 2
    """,
)
def retention_plan(spark, sf):
    meta = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("uploaded_at"))
    plan = rollups.retention_plan(meta, 1000, F.lit("2001-01-01").cast("timestamp"))
    return plan.groupBy("o_orderpriority", "fate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dormancy",
    """
    WITH m AS (SELECT user_id % 7 AS team_id, user_id, max(ts) AS seen, max(value) > 99 AS paid FROM events GROUP BY 1, 2),
    o AS (SELECT team_id, min(user_id) AS owner_id FROM m GROUP BY 1)
    SELECT team_id, CAST(floor((epoch_us(TIMESTAMP '2024-04-29') - epoch_us(max(seen) FILTER (user_id = owner_id))) / 86400000000.0) AS BIGINT) AS idle_days,
           count(*) FILTER (user_id <> owner_id AND paid) AS paid_members FROM m JOIN o USING (team_id) GROUP BY 1
    """,
)
def dormancy(spark, sf):
    team = F.pmod("user_id", F.lit(7))
    m = events(spark, sf).groupBy(team.alias("team_id"), "user_id").agg(
        F.max("ts").alias("last_seen"), F.when(F.max("value") > 99, "paid").otherwise("free").alias("plan")
    )
    teams = m.groupBy("team_id").agg(F.min("user_id").alias("owner_id"))
    return rollups.dormancy(teams, m, F.lit("2024-04-29").cast("timestamp")).select("team_id", "idle_days", "paid_members")


@query(
    "class_disagreement",
    """
    SELECT o_orderstatus, l_linestatus, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE (o_orderstatus, l_linestatus) NOT IN (('F', 'F'), ('O', 'O'), ('P', 'F'), ('P', 'O')) GROUP BY 1, 2
    """,
)
def class_disagreement(spark, sf):
    """Lines whose status class does not go with that of their order; the maps come from the data."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = li.join(o, "l_orderkey").groupBy("o_orderstatus", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    left = rows.select(F.col("o_orderstatus").alias("code"), F.col("o_orderstatus").alias("class")).distinct()
    right = rows.select(F.col("l_linestatus").alias("code"), F.col("l_linestatus").alias("class")).distinct()
    agree = rows.select(F.col("o_orderstatus").alias("left_class"), F.col("l_linestatus").alias("right_class")).distinct()
    agree = agree.where((F.col("left_class") == F.col("right_class")) | (F.col("left_class") == "P"))
    out = rollups.class_disagreement(rows, "o_orderstatus", "l_linestatus", left, right, agree)
    return out.select("o_orderstatus", "l_linestatus", "n")


@query(
    "exchange_stats",
    """
    WITH x AS (SELECT o_orderpriority AS p, epoch_us(min(l_shipdate)) - epoch_us(any_value(o_orderdate)) AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)
    SELECT p AS o_orderpriority, count(*) AS n_total, count(*) FILTER (d IS NULL) AS n_timeouts, count(*) FILTER (d > 60 * 86400000000) AS n_slow, CAST(max(greatest(0, d)) AS BIGINT) AS max_latency_us FROM x GROUP BY 1
    """,
)
def exchange_stats(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").join(first, "o_orderkey", "left")
    d = F.unix_micros(F.col("s").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    ex = o.select(
        "o_orderpriority", F.when(d.isNotNull(), F.greatest(F.lit(0), d)).alias("latency_us"), d.isNull().alias("timed_out"),
        F.coalesce(d > 60 * 86_400_000_000, F.lit(False)).alias("slow"), F.lit(None).cast("string").alias("response_rcode"), F.lit("A").alias("request_qtype"),
    )
    return rollups.exchange_stats(ex, ["o_orderpriority"]).select("o_orderpriority", "n_total", "n_timeouts", "n_slow", "max_latency_us")


@query(
    "cause_tally",
    """
    SELECT l_returnflag AS source, CAST(l_linenumber AS VARCHAR) AS code, count(*) AS n, CASE WHEN l_linenumber >= 7 THEN 'warn' WHEN l_linenumber = 1 THEN 'info' ELSE 'notice' END AS severity
    FROM lineitem GROUP BY l_returnflag, l_linenumber
    """,
)
def cause_tally(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linenumber").cast("string").alias("code"), "l_linenumber")
    lookup = li.where((F.col("l_linenumber") >= 7) | (F.col("l_linenumber") == 1)).groupBy("code").agg(
        F.when(F.max("l_linenumber") >= 7, "warn").otherwise("info").alias("severity")
    )
    return rollups.cause_tally(li.select("source", "code"), ["source", "code"], lookup).select("source", "code", "n", "severity")


@query(
    "ranked_fixes",
    """
    WITH f AS (SELECT DISTINCT p_type AS rule_id, CASE WHEN p_size % 3 = 0 THEN 'generic' ELSE p_brand END AS vendor, p_name AS fix FROM part),
    v AS (SELECT DISTINCT p_brand AS vendor FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.02 FROM part) AND p_size = 50),
    t AS (SELECT f.*, CASE WHEN v.vendor IS NOT NULL THEN 0 WHEN f.vendor = 'generic' THEN 1 ELSE 3 END AS tier FROM f LEFT JOIN v ON v.vendor = f.vendor)
    SELECT rule_id, vendor, fix, tier FROM t QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY tier, vendor, fix) <= 6
    """,
)
def ranked_fixes(spark, sf):
    p = table(spark, sf, "part")
    fixes = p.select(F.lit("all").alias("capture_id"), F.col("p_type").alias("rule_id"), F.when(F.col("p_size") % 3 == 0, "generic").otherwise(F.col("p_brand")).alias("vendor"), F.col("p_name").alias("fix")).distinct()
    mean = p.agg((F.avg("p_retailprice") * 1.02).alias("m")).scalar()
    seen = p.where((F.col("p_retailprice") > mean) & (F.col("p_size") == 50)).select(F.lit("all").alias("capture_id"), F.col("p_brand").alias("vendor"))
    return classify.rank_fixes(fixes, seen).select("rule_id", "vendor", "fix", "tier")


@query(
    "top_orders",
    "SELECT c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) <= 8",
)
def top_orders(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").join(c, "o_custkey")
    return top_per(o, ["c_mktsegment"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 8).select("c_mktsegment", "o_orderkey", "o_totalprice")


@query(
    "agent_labels",
    r"""
    WITH a AS (
      SELECT DISTINCT s_nationkey AS capture_id,
             CASE s_suppkey % 11 WHEN 0 THEN 'ACME   Packet 7.' || s_suppkey WHEN 1 THEN 'Acme Corp' WHEN 2 THEN 'Mediant SW/MP-1' || s_suppkey WHEN 3 THEN 'mp-5' || s_suppkey
                  WHEN 4 THEN 'SBC 5' || s_suppkey WHEN 5 THEN 'sbc swe' WHEN 6 THEN 'Cisco-CUBE' WHEN 7 THEN 'cisco phone' WHEN 8 THEN 'FreePBX on Asterisk' WHEN 9 THEN 'Oracle SD SBC 7123' END AS agent
      FROM supplier),
    r(vendor, pattern) AS (VALUES
      ('oracle-acme', 'acme\s*packet|net-net|oracle|sd\s*sbc|os-e'), ('audiocodes', 'audiocodes|mediant|mp-1\d{2}|mp-5\d{2}'), ('ribbon', 'ribbon|sonus|sbc\s*[57]\d{3}|nbs|sbc\s*swe'),
      ('cisco-cube', 'cisco-?sipgateway|cisco-?cube|cisco\s*ios'), ('freeswitch', 'freeswitch'), ('asterisk', 'asterisk|freepbx'))
    SELECT DISTINCT capture_id, vendor FROM a JOIN r ON regexp_matches(lower(agent), pattern)
    """,
)
def agent_labels(spark, sf):
    """Equipment named by texts made of suppliers, per nation."""
    number = F.col("s_suppkey")
    said = [F.concat(F.lit("ACME   Packet 7."), number), F.lit("Acme Corp"), F.concat(F.lit("Mediant SW/MP-1"), number), F.concat(F.lit("mp-5"), number), F.concat(F.lit("SBC 5"), number), F.lit("sbc swe"),
            F.lit("Cisco-CUBE"), F.lit("cisco phone"), F.lit("FreePBX on Asterisk"), F.lit("Oracle SD SBC 7123"), F.lit(None).cast("string")]
    agents = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("capture_id"), F.array(*said)[(number % 11).cast("int")].alias("agent"))
    found = label_texts(agents, rule_table(spark, VENDOR_RULES), ["capture_id"], "agent")
    return found.select("capture_id", F.col("label").alias("vendor"))
