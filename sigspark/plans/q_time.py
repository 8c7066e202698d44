"""Queries: bursts, repeats, windows, sweeps, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import ordered, repeats
from sigspark.operators.dialogs import transaction_rollup
from sigspark.plans.registry import query
from sigspark.plans.slices import Scanner, last_value, running_sum, scan, top_per
from sigspark.session import table

EVENT_KEY = ["ts", "event_id"]


def events(spark, sf):
    """Events with a session-zone timestamp (the parquet column has no zone)."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "burst_windows",
    """
    SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n_errors,
           count(DISTINCT user_id) AS n_users
    FROM events WHERE event_type = 'error'
    GROUP BY 1 HAVING count(DISTINCT user_id) >= 3
    """,
)
def burst_windows(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'").select("ts", "user_id")
    out = repeats.burst_buckets(errors, "ts", "10 minutes", "user_id")
    return out.where("n_entities >= 3").select(
        F.col("bucket_start").alias("window_start"),
        F.col("n_rows").alias("n_errors"),
        F.col("n_entities").alias("n_users"),
    ).orderBy("window_start")


@query(
    "burst_buckets",
    """
    SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket_start, count(*) AS n_rows,
           count(DISTINCT user_id) AS n_entities
    FROM events GROUP BY 1, 2
    """,
)
def burst_buckets(spark, sf):
    return repeats.burst_buckets(events(spark, sf), "ts", "1 hour", "user_id", ["event_type"])


@query(
    "burst_lookback",
    """
    WITH e AS (SELECT epoch_us(ts) AS t, user_id FROM events WHERE event_type = 'error'),
    c AS (SELECT *, count(DISTINCT user_id) OVER (ORDER BY t RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS k FROM e),
    q AS (SELECT DISTINCT t FROM c WHERE k >= 3),
    m AS (SELECT c.t, c.user_id, (SELECT min(q.t) FROM q WHERE q.t >= c.t) AS nq FROM c),
    i AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS new FROM q),
    n AS (SELECT t, sum(new) OVER (ORDER BY t) AS window_no FROM i)
    SELECT CAST(n.window_no AS BIGINT) AS window_no, make_timestamp(min(m.t)) AS start_ts, make_timestamp(max(m.t)) AS end_ts,
           count(DISTINCT m.user_id) AS n_entities, count(*) AS n_rows
    FROM m JOIN n ON n.t = m.nq WHERE m.nq - m.t <= 600000000 GROUP BY n.window_no
    """,
)
def burst_lookback(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'")
    return repeats.burst_windows(errors, "ts", 600, "user_id", 3, tie=["event_id"])


@query(
    "collapse_repeats",
    """
    SELECT user_id, event_type, props, count(*) AS copies, min(ts) AS first_ts, max(ts) AS last_ts,
           arg_min(event_id, ts) AS first_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us
    FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 2
    """,
)
def collapse_repeats(spark, sf):
    groups, _ = repeats.collapse_repeats(events(spark, sf), ["user_id", "event_type", "props"], EVENT_KEY, "event_id")
    return groups.withColumnRenamed("count", "copies")


@query(
    "repeat_pointer",
    """
    WITH r AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS repeat_of FROM events)
    SELECT event_id, repeat_of FROM r WHERE event_id <> repeat_of
    """,
)
def repeat_pointer(spark, sf):
    _, members = repeats.collapse_repeats(events(spark, sf), ["user_id", "event_type", "props"], EVENT_KEY, "event_id")
    return members.select("event_id", "repeat_of")


@query(
    "repeat_classify",
    """
    WITH g AS (SELECT user_id, event_type, props, count(*) AS copies, min(ts) AS first_ts, max(ts) AS last_ts
               FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    a AS (SELECT g.*, (SELECT min(e.ts) FROM events e WHERE e.user_id = g.user_id AND e.event_type = 'purchase' AND e.ts >= g.first_ts) AS answer_ts FROM g)
    SELECT user_id, event_type, props, copies, answer_ts,
           CASE WHEN answer_ts IS NULL THEN 'never-arrived' WHEN answer_ts > last_ts THEN 'slow-far-end' ELSE 'resolved' END AS code
    FROM a
    """,
)
def repeat_classify(spark, sf):
    from sigspark.operators.pairing import asof_next

    ev = events(spark, sf)
    groups, _ = repeats.collapse_repeats(
        ev.where("event_type <> 'purchase'"), ["user_id", "event_type", "props"], EVENT_KEY, "event_id"
    )
    answers = asof_next(
        groups, ev.where("event_type = 'purchase'"), ["user_id"], "first_ts", "ts", "first_id", "event_id"
    ).select("user_id", "first_id", F.col("next_ts").alias("answer_ts"))
    out = groups.join(answers, ["user_id", "first_id"])
    code = (
        F.when(F.col("answer_ts").isNull(), "never-arrived")
        .when(F.col("answer_ts") > F.col("last_ts"), "slow-far-end")
        .otherwise("resolved")
    )
    return out.select("user_id", "event_type", "props", F.col("count").alias("copies"), "answer_ts", code.alias("code"))


@query(
    "sessions_gap",
    """
    WITH d AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS new
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM d)
    SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events
    FROM s GROUP BY user_id, session_no
    """,
)
def sessions_gap(spark, sf):
    s = ordered.sessionize(events(spark, sf).select("user_id", "ts", "event_id"), ["user_id"], "ts", 7200, ["event_id"])
    return s.groupBy("user_id", "session_no").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events")
    )


@query(
    "dialog_state",
    """
    WITH d AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS new
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM d)
    SELECT user_id, CAST(session_no AS BIGINT) AS session_no,
           CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_and(event_type = 'error') THEN 'failed'
                WHEN bool_or(event_type = 'signup') THEN 'answered' ELSE 'in-progress' END AS state,
           arg_min(event_type, ts) AS opened_by
    FROM s GROUP BY user_id, session_no
    """,
)
def dialog_state(spark, sf):
    base = events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    s = ordered.sessionize(base, ["user_id"], "ts", 7200, ["event_id"])
    kind = F.col("event_type")
    state = (
        F.when(F.max((kind == "purchase").cast("int")) == 1, "completed")
        .when(F.min((kind == "error").cast("int")) == 1, "failed")
        .when(F.max((kind == "signup").cast("int")) == 1, "answered")
        .otherwise("in-progress")
    )
    return s.groupBy("user_id", "session_no").agg(
        state.alias("state"), F.min_by("event_type", F.struct("ts", "event_id")).alias("opened_by")
    )


@query(
    "tx_rollup",
    """
    SELECT user_id, event_type, count(*) AS n_rows, max(value) AS worst_value, count(*) - count(DISTINCT props) AS n_repeats
    FROM events GROUP BY 1, 2
    """,
)
def tx_rollup(spark, sf):
    out = transaction_rollup(events(spark, sf), ["user_id", "event_type"], "value", F.col("props"))
    return out.select("user_id", "event_type", "n_rows", F.col("worst_status").alias("worst_value"), "n_repeats")


@query(
    "delta_prev",
    """
    SELECT event_id, user_id,
           CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS delta_us
    FROM events
    """,
)
def delta_prev(spark, sf):
    out = scan(
        events(spark, sf).select("event_id", "user_id", "ts"), ["user_id"], EVENT_KEY,
        {"_p": last_value(F.unix_micros("ts"), inclusive=False)},
    )
    return out.select("event_id", "user_id", (F.unix_micros("ts") - F.col("_p")).alias("delta_us"))


@query(
    "gaps_over",
    """
    WITH d AS (SELECT user_id, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap_us FROM events)
    SELECT user_id, event_id, gap_us FROM d WHERE gap_us > 43200000000
    """,
)
def gaps_over(spark, sf):
    return ordered.gaps(events(spark, sf), ["user_id"], "ts", 43200, EVENT_KEY).select("user_id", "event_id", "gap_us")


@query(
    "longest_gap",
    """
    WITH d AS (SELECT user_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap_us FROM events)
    SELECT user_id, count(*) AS n_gaps, max(gap_us) AS max_gap_us FROM d WHERE gap_us > 3600000000 GROUP BY user_id
    """,
)
def longest_gap(spark, sf):
    return ordered.longest_gap(events(spark, sf), ["user_id"], "ts", 3600, EVENT_KEY)


@query(
    "peak_concurrency",
    """
    WITH i AS (SELECT o_orderpriority AS p, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 30 * 86400000000 + 1 AS e FROM orders),
    d AS (SELECT p, s AS t, 1 AS d FROM i UNION ALL SELECT p, e, -1 FROM i),
    g AS (SELECT p, t, d, sum(d) AS n FROM d GROUP BY p, t, d),
    r AS (SELECT p, t, sum(n) OVER (PARTITION BY p ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM g)
    SELECT p AS o_orderpriority, CAST(max(open) AS BIGINT) AS peak FROM r GROUP BY p
    """,
)
def peak_concurrency(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("s")
    ).withColumn("e", F.col("s") + F.expr("INTERVAL 30 DAYS"))
    return ordered.peak_concurrency(o, "s", "e", ["o_orderpriority"]).select("o_orderpriority", "peak")


@query(
    "row_ids",
    """
    SELECT event_id, event_type, 's' || CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS VARCHAR) AS id FROM events
    """,
)
def row_ids(spark, sf):
    base = events(spark, sf).select("event_id", "event_type", "ts")
    return ordered.number_rows(base, ["event_type"], EVENT_KEY, "s").select("event_id", "event_type", "id")


@query(
    "rate_limit",
    """
    WITH h AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
               RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS hits_before FROM events)
    SELECT event_id, user_id, hits_before FROM h WHERE hits_before >= 5
    """,
)
def rate_limit(spark, sf):
    base = events(spark, sf).select("event_id", "user_id", "ts")
    return ordered.over_limit(base, ["user_id"], "ts", 86400, 5, ["event_id"]).select("event_id", "user_id", "hits_before")


@query(
    "repeated_values",
    "SELECT user_id, props, count(*) AS times FROM events GROUP BY 1, 2 HAVING count(*) >= 3",
)
def repeated_values(spark, sf):
    return ordered.repeated(events(spark, sf), ["user_id"], "props", 3)


@query(
    "first_per_key",
    """
    SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY 1, 2
    """,
)
def first_per_key(spark, sf):
    base = events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    return ordered.pick(base, ["user_id", "event_type"], EVENT_KEY).select("user_id", "event_type", "event_id", "value")


@query(
    "ewma_jitter",
    """
    WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, (value / 16.0)::DOUBLE AS j FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, r.j + (e.value - r.j) / 16.0 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, round(avg(j), 6) AS mean_j, round(max(j), 6) AS max_j FROM r GROUP BY user_id
    """,
)
def ewma_jitter(spark, sf):
    base = events(spark, sf).select("user_id", "ts", "event_id", "value")
    j = ordered.ewma(base, ["user_id"], EVENT_KEY, "value")
    return j.groupBy("user_id").agg(F.round(F.avg("ewma"), 6).alias("mean_j"), F.round(F.max("ewma"), 6).alias("max_j"))


@query(
    "event_runs",
    """
    WITH d AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type OR p = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS event_no FROM d)
    SELECT user_id, CAST(event_no AS BIGINT) AS event_no, event_type, min(ts) AS ts, max(value) AS duration_units, bool_or(event_type = 'purchase') AS ended
    FROM n GROUP BY user_id, event_no, event_type
    """,
)
def event_runs(spark, sf):
    base = events(spark, sf).withColumn("done", F.col("event_type") == "purchase")
    return ordered.fold_events(base, ["user_id"], EVENT_KEY, ["event_type"], "value", "done")


@query(
    "timeline_union",
    """
    WITH u AS (SELECT user_id AS who, ts, 'event' AS kind, event_id AS row_id FROM events
               UNION ALL SELECT o_custkey, o_orderdate, 'order', o_orderkey FROM orders)
    SELECT who, kind, row_id, ts,
           CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY who ORDER BY ts, kind, row_id)) AS BIGINT) AS delta_us
    FROM u
    """,
)
def timeline_union(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("who"), "ts", F.lit("event").alias("kind"), F.col("event_id").alias("row_id"))
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("row_id"),
    )
    t = ordered.timeline(e, o, keys=["who"], ts="ts", order=["kind", "row_id"])
    return t.select("who", "kind", "row_id", "ts", F.round(F.col("delta_s") * 1e6).cast("bigint").alias("delta_us"))


@query(
    "top_values",
    """
    WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events)
    SELECT event_type, event_id, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
    """,
)
def top_values(spark, sf):
    base = events(spark, sf).select("event_type", "event_id", "value")
    return top_per(base, ["event_type"], [F.col("value").desc(), F.col("event_id")], 8)


@query(
    "running_totals",
    """
    SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_cents,
           count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS errors_so_far
    FROM events
    """,
)
def running_totals(spark, sf):
    base = events(spark, sf).select("event_id", "user_id", "ts", "value", "event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    s = Scanner(base, ["user_id"], EVENT_KEY).add(
        total_cents=running_sum(cents), errors_so_far=running_sum((F.col("event_type") == "error").cast("bigint"))
    )
    return s.df.select("event_id", "user_id", "total_cents", "errors_so_far")
