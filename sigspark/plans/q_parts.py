"""Queries that run single operators on rows derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.redact import mask_uris
from sigspark.functions.sip import digits, rtp_header, same_party, transaction_key
from sigspark.operators import rowdiff
from sigspark.operators.dialogs import group_dialogs
from sigspark.plans.q_class import LINE_COMPARATORS, LINE_SQL, line_items
from sigspark.plans.q_time import events
from sigspark.plans.registry import query
from sigspark.session import table
from sigspark.sources.files import classify_content




def numbers(spark, sf):
    """A ten-digit number for each customer."""
    return table(spark, sf, "customer").select("c_custkey", (F.lit(2_000_000_000) + F.col("c_custkey") * 7_919).cast("string").alias("number"))


@query(
    "dialog_tags",
    """
    WITH RECURSIVE s AS (
      SELECT user_id, event_id, event_type AS f, CASE WHEN event_id % 4 = 0 THEN 'view' WHEN event_id % 4 = 1 THEN 'click' END AS t,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events),
    r AS (
      SELECT user_id, rn, event_id, [f] AS opened, f AS tag FROM s WHERE rn = 1
      UNION ALL
      SELECT s.user_id, s.rn, s.event_id,
             CASE WHEN list_contains(opened, f) OR coalesce(list_contains(opened, t), false) THEN opened ELSE list_append(opened, f) END,
             CASE WHEN list_contains(opened, f) OR coalesce(list_contains(opened, t), false)
                  THEN opened[CAST(least(coalesce(nullif(list_position(opened, f), 0), 999), coalesce(nullif(list_position(opened, t), 0), 999)) AS INT)] ELSE f END
      FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
    SELECT event_id, tag AS dialog_tag FROM r
    """,
)
def dialog_tags(spark, sf):
    """Events as messages of a user: the type is the own tag, every fourth names a view, the next a click as the peer."""
    peer = F.when(F.col("event_id") % 4 == 0, "view").when(F.col("event_id") % 4 == 1, "click")
    rows = events(spark, sf).select("user_id", "event_id", "ts", F.col("event_type").alias("f"), peer.alias("t"))
    return group_dialogs(rows, ["user_id"], "f", "t", ["ts", "event_id"]).select("event_id", "dialog_tag")


@query(
    "party_numbers",
    """
    WITH p AS (
      SELECT c_custkey, number AS a,
             CASE c_custkey % 5 WHEN 0 THEN '+' || regexp_replace(number, '-', '', 'g') WHEN 1 THEN '00' || regexp_replace(number, '-', '', 'g')
                                WHEN 2 THEN right(regexp_replace(number, '-', '', 'g'), 7) WHEN 3 THEN right(regexp_replace(number, '-', '', 'g'), 4) ELSE reverse(number) END AS b
      FROM (SELECT c_custkey, CAST(2000000000 + c_custkey * 7919 AS VARCHAR) AS number FROM customer)),
    d AS (SELECT c_custkey, regexp_replace(a, '[^0-9]', '', 'g') AS x, regexp_replace(b, '[^0-9]', '', 'g') AS y FROM p),
    v AS (
      SELECT c_custkey, unnest([x, CASE WHEN length(x) > 2 AND starts_with(x, '00') THEN substring(x, 3) WHEN length(x) > 1 AND starts_with(x, '0') THEN substring(x, 2) ELSE x END]) AS x, y FROM d),
    w AS (
      SELECT c_custkey, x, unnest([y, CASE WHEN length(y) > 2 AND starts_with(y, '00') THEN substring(y, 3) WHEN length(y) > 1 AND starts_with(y, '0') THEN substring(y, 2) ELSE y END]) AS y FROM v)
    SELECT c_custkey, bool_or(x = y OR (length(x) >= length(y) AND length(y) >= 6 AND ends_with(x, y)) OR (length(y) >= length(x) AND length(x) >= 6 AND ends_with(y, x))) AS same
    FROM w GROUP BY 1
    """,
)
def party_numbers(spark, sf):
    """Phone numbers written in five ways: international, with 00, the last seven or four digits, backwards."""
    c = numbers(spark, sf)
    bare, kind = digits(F.col("number")), F.col("c_custkey") % 5
    other = (
        F.when(kind == 0, F.concat(F.lit("+"), bare)).when(kind == 1, F.concat(F.lit("00"), bare)).when(kind == 2, F.right(bare, F.lit(7)))
        .when(kind == 3, F.right(bare, F.lit(4))).otherwise(F.reverse("number"))
    )
    return c.select("c_custkey", same_party(F.col("number"), other).alias("same"))


@query(
    "masked_uris",
    """
    SELECT c_custkey, 'call sip:+' || substring(n, 1, 4) || '…' || right(n, 2) || '@h or ' || n || ', then tel:+' || repeat('1 ', 60) || substring(n, 1, 4) || '…' || right(n, 2) AS masked
    FROM (SELECT c_custkey, CAST(2000000000 + c_custkey * 7919 AS VARCHAR) AS n FROM customer)
    """,
)
def masked_uris(spark, sf):
    """Numbers behind a scheme are masked, however far behind; other numbers stay."""
    n = F.col("number")
    text = F.concat(F.lit("call sip:+"), n, F.lit("@h or "), n, F.lit(", then tel:+" + "1 " * 60), n)
    return numbers(spark, sf).select("c_custkey", mask_uris(text).alias("masked"))


@query(
    "rtp_headers",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 90 AS INT) AS pt, l_linenumber % 2 = 1 AS marker, CAST(l_partkey % 65536 AS INT) AS seq,
           CAST(l_suppkey * 65537 % 4294967296 AS BIGINT) AS rtp_ts, CAST(l_orderkey AS BIGINT) AS ssrc
    FROM lineitem
    """,
)
def rtp_headers(spark, sf):
    """Order lines written as packet headers and read back."""

    def number(x, n):
        return F.lpad(F.hex(x.cast("bigint")), 2 * n, "0")

    li = table(spark, sf, "lineitem")
    second = F.col("l_linenumber") + 90 + F.when(F.col("l_linenumber") % 2 == 1, 128).otherwise(0)
    stamp = F.col("l_suppkey").cast("bigint") * 65537 % 4294967296
    payload = F.unhex(F.concat(F.lit("80"), number(second, 1), number(F.col("l_partkey") % 65536, 2), number(stamp, 4), number(F.col("l_orderkey"), 4), F.lit("FF")))
    return li.select("l_orderkey", "l_linenumber", rtp_header(payload).alias("h")).select("l_orderkey", "l_linenumber", "h.pt", "h.marker", "h.seq", "h.rtp_ts", "h.ssrc")


@query(
    "transaction_keys",
    """
    SELECT CAST(event_id % 7 AS VARCHAR) || '|' || CASE WHEN event_type IN ('click', 'error') THEN 'INVITE' ELSE upper(event_type) END || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS tx,
           count(*) AS n
    FROM events GROUP BY 1
    """,
)
def transaction_keys(spark, sf):
    """Events as requests: clicks acknowledge and errors cancel the request before them."""
    kind = F.when(F.col("event_type") == "click", "ACK").when(F.col("event_type") == "error", "CANCEL").otherwise(F.upper("event_type"))
    branch = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return events(spark, sf).groupBy(transaction_key(kind, F.col("event_id") % 7, branch).alias("tx")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "item_groups",
    f"""
    {LINE_SQL}
    SELECT tag, severity, ingress AS ingress_value, egress AS egress_value, count(DISTINCT l_orderkey) AS n_calls, count(*) AS n_items,
           list_sort(list_distinct(list(l_linenumber)))[1:3] AS sample
    FROM i GROUP BY ALL
    """,
)
def item_groups(spark, sf):
    """Changes between the lines of orders, grouped by what changed into what, with three line numbers as samples."""
    items = line_items(spark, sf).withColumns({"label": F.col("tag"), "ingress_value": F.col("ingress"), "egress_value": F.col("egress")})
    most = table(spark, sf, "lineitem").count() * len(LINE_COMPARATORS)
    return rowdiff.group_items(items, ["severity"], "l_orderkey", "l_linenumber", 3, most).drop("label")


@query(
    "content_kinds",
    r"""
    SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\t\n\r -~]', '', 'g')) >= 0.85 * greatest(octet_length(encode(text)), 1)
           AND regexp_matches(text, '(?i)\b(?:received\s+from|sent\s+to)\b') THEN 'text-log' ELSE 'unknown' END AS kind
    FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'sent to peer' ELSE '' END AS text FROM documents)
    """,
)
def content_kinds(spark, sf):
    """Whole texts as landed files; every fifth ends with a line as logs have it."""
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\nsent to peer").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", classify_content(F.encode(text, "UTF-8")).alias("kind"))
