"""Queries that cut messages out of logs and streams, on logs and streams made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.sip import body_parts, header, parse_messages
from sigspark.operators.media import sequence_accounting
from sigspark.operators.reassembly import frame_stream, order_stream, reassemble_fragments, text_length
from sigspark.plans.registry import query
from sigspark.plans.slices import Scanner, lead, running_sum
from sigspark.session import stage, table
from sigspark.sources.textlog import split_messages

# Each turn of a conversation as a message in a log: some lengths are too large, some bodies may hold start lines, some turns end with dashes.
LOG_SQL = r"""
    t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    p AS (
      SELECT conv_id, turn, list_concat(
        [CASE WHEN turn % 2 = 0 THEN 'MESSAGE sip:u' || turn || '@h SIP/2.0' ELSE 'SIP/2.0 200 OK' END,
         CASE WHEN turn % 3 = 1 THEN 'Content-Type: message/cpim' ELSE 'Content-Type: text/plain' END,
         'Content-Length: ' || (strlen(text) + [0, 300, 400, 5][CAST(turn % 4 + 1 AS INT)]), ''],
        string_split(text, chr(10)), CASE WHEN turn % 5 = 4 THEN ['------------'] ELSE [''] END) AS v
      FROM t),
    l AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n, v,
             regexp_matches(v, '^(MESSAGE \S+ SIP/2.0|SIP/2.0 200 .*)$') AS s, v = '------------' AS d, trim(v) = '' AS b
      FROM (SELECT conv_id, turn, unnest(v) AS v, unnest(range(len(v))) AS i FROM p))
"""


def conversation_log(spark, sf):
    """(capture_id, line_no, value): the lines that LOG_SQL makes."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    extra = F.element_at(F.array(F.lit(0), F.lit(300), F.lit(400), F.lit(5)), (F.col("turn") % 4 + 1).cast("int"))
    start = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("MESSAGE sip:u"), F.col("turn"), F.lit("@h SIP/2.0"))).otherwise("SIP/2.0 200 OK")
    kind = F.when(F.col("turn") % 3 == 1, "Content-Type: message/cpim").otherwise("Content-Type: text/plain")
    length = F.concat(F.lit("Content-Length: "), (F.octet_length("text") + extra).cast("string"))
    lines = F.concat(F.array(start, kind, length, F.lit("")), F.split("text", "\n"), F.array(F.when(F.col("turn") % 5 == 4, "------------").otherwise("")))
    # the lines of a turn are numbered on from those of the turns before
    sized = Scanner(t.withColumn("lines", lines).withColumn("n", F.size("lines").cast("bigint")), ["conv_id"], ["turn"]).add(_end=running_sum(F.col("n"))).df
    return sized.select(F.col("conv_id").alias("capture_id"), (F.col("_end") - F.col("n")).alias("_base"), F.posexplode("lines").alias("i", "value")).select(
        "capture_id", (F.col("_base") + F.col("i") + 1).alias("line_no"), "value"
    )


@query(
    "bare_log_messages",
    "WITH RECURSIVE" + LOG_SQL + r""",
    z AS (SELECT conv_id, max(n) AS n FROM l GROUP BY conv_id),
    r AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS phase, CAST(0 AS BIGINT) AS began, CAST(NULL AS BIGINT) AS declared, false AS nested, CAST(0 AS BIGINT) AS got, '' AS head, '' AS body,
             CAST(NULL AS BIGINT) AS c_began, CAST(NULL AS BIGINT) AS c_declared, CAST(NULL AS BIGINT) AS c_got, '' AS c_head, '' AS c_body, '' AS c_why
      FROM z
      UNION ALL
      SELECT conv_id, n,
             CASE WHEN s AND (phase = 0 OR shut) THEN 1 WHEN shut OR phase = 0 THEN 0 WHEN phase = 1 AND b THEN 2 ELSE phase END,
             CASE WHEN s AND (phase = 0 OR shut) THEN n ELSE began END,
             CASE WHEN s AND (phase = 0 OR shut) THEN NULL WHEN phase = 1 AND declared IS NULL AND starts_with(v, 'Content-Length: ') THEN CAST(substring(v, 17) AS BIGINT) ELSE declared END,
             CASE WHEN s AND (phase = 0 OR shut) THEN false WHEN phase = 1 THEN nested OR v = 'Content-Type: message/cpim' ELSE nested END,
             CASE WHEN s AND (phase = 0 OR shut) THEN 0 WHEN phase = 2 AND NOT shut THEN got + strlen(v) + 2 ELSE got END,
             CASE WHEN s AND (phase = 0 OR shut) THEN v || chr(13) || chr(10) WHEN phase = 1 AND NOT b THEN head || v || chr(13) || chr(10) ELSE head END,
             CASE WHEN s AND (phase = 0 OR shut) THEN '' WHEN phase = 2 AND NOT shut THEN body || v || chr(13) || chr(10) ELSE body END,
             CASE WHEN shut THEN began END, declared, got, head, body, CASE WHEN got < declared THEN CASE WHEN d THEN 'separator' ELSE 'next message' END END
      FROM (
        SELECT l.*, r.phase, r.began, r.declared, r.nested, r.got, r.head, r.body,
               coalesce((phase = 1 AND (l.s OR l.d)) OR (phase = 1 AND l.b AND declared = 0)
                 OR (phase = 2 AND CASE WHEN declared IS NULL OR got >= declared THEN l.b OR l.s OR l.d ELSE l.d OR (l.s AND NOT nested) END), false) AS shut
        FROM r JOIN l ON l.conv_id = r.conv_id AND l.n = r.n + 1)),
    m AS (
      SELECT conv_id, c_began AS began, c_declared AS declared, c_got AS got, c_head AS head, c_body AS body, c_why AS why FROM r WHERE c_began IS NOT NULL
      UNION ALL
      SELECT r.conv_id, began, declared, got, head, body, CASE WHEN got < declared THEN 'end of input' END FROM r JOIN z USING (conv_id, n) WHERE phase > 0)
    SELECT conv_id AS capture_id, began AS line_no, declared, got, why AS stopped,
           md5(replace(head, 'Content-Length: ' || declared || chr(13), 'Content-Length: ' || strlen(body) || chr(13)) || chr(13) || chr(10) || body) AS raw_md5
    FROM m
    """,
)
def bare_log_messages(spark, sf):
    """Messages of logs made of conversations, with the reason where a body is shorter than declared."""
    cut = split_messages(conversation_log(spark, sf), ["capture_id"])
    return cut.select("capture_id", "line_no", "declared", "got", "stopped", F.md5(F.encode("raw", "UTF-8")).alias("raw_md5"))


# Each conversation as a byte stream of 97-byte segments: rubbish before some messages, bodies that end without a line end, some last ones cut off.
STREAM_SQL = r"""
    t AS (
      SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    m AS (
      SELECT conv_id, turn,
             CASE WHEN turn % 4 = 3 THEN 'rubbish without an end' || chr(13) || chr(10) ELSE '' END
             || CASE WHEN turn % 2 = 0 THEN 'MESSAGE sip:u' || turn || '@h SIP/2.0' ELSE 'SIP/2.0 200 OK' END || chr(13) || chr(10)
             || 'Content-Length: ' || (length(text) + CASE WHEN turn = last AND conv_id % 3 = 0 THEN 50 ELSE 0 END) || chr(13) || chr(10) || chr(13) || chr(10) || text AS part
      FROM t),
    s AS (SELECT conv_id, string_agg(part, '' ORDER BY turn) AS stream FROM m GROUP BY conv_id)
"""


def conversation_stream(spark, sf):
    """(flow, n, ts, seq, payload): the segments that STREAM_SQL describes; conversation and turn decide the order."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("flow"), "turn", plain.alias("text"))
    s = Scanner(t, ["flow"], ["turn"]).add(_after=lead(F.col("turn")))
    missing = F.when(F.col("_after").isNull() & (F.col("flow") % 3 == 0), 50).otherwise(0)
    start = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("MESSAGE sip:u"), F.col("turn"), F.lit("@h SIP/2.0"))).otherwise("SIP/2.0 200 OK")
    rubbish = F.when(F.col("turn") % 4 == 3, "rubbish without an end\r\n").otherwise("")
    part = F.concat(rubbish, start, F.lit("\r\nContent-Length: "), (F.length("text") + missing).cast("string"), F.lit("\r\n\r\n"), F.col("text"))
    s.with_column("_part", part).add(_end=running_sum(F.length("_part").cast("bigint")))
    # the pieces of a part between two multiples of 97
    begin = F.col("_end") - F.length("_part")
    cuts = F.sequence(F.floor(begin / 97), F.floor((F.col("_end") - 1) / 97))
    pieces = s.df.select("flow", begin.alias("_b"), "_end", "_part", F.explode(cuts).alias("n"))
    a, z = F.greatest(F.col("_b"), F.col("n") * 97), F.least(F.col("_end"), (F.col("n") + 1) * 97)
    text = F.substr("_part", (a - F.col("_b") + 1).cast("int"), (z - a).cast("int"))
    whole = pieces.groupBy("flow", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a.alias("a"), text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    return whole.select("flow", "n", F.timestamp_seconds("n").alias("ts"), (F.col("n") * 97).alias("seq"), F.encode("t", "ISO-8859-1").alias("payload"))


@query(
    "framed_messages",
    "WITH RECURSIVE" + STREAM_SQL + r""",
    r AS (
      SELECT conv_id, stream AS rest, CAST(0 AS BIGINT) AS began, CAST(0 AS BIGINT) AS until, false AS real, false AS over FROM s
      UNION ALL
      SELECT conv_id, substring(rest, skip + CASE WHEN starts THEN size ELSE hop END + 1), until + skip, until + skip + CASE WHEN starts THEN size ELSE hop END, starts AND size <= length(rest) - skip,
             CASE WHEN starts THEN size IS NULL OR size > length(rest) - skip ELSE hop = 0 END
      FROM (
        SELECT *, position(chr(13) || chr(10) || chr(13) || chr(10) IN tail) + 3 + CAST(regexp_extract(tail, '\nContent-Length: (\d+)', 1) AS BIGINT) AS size,
               length(regexp_extract(tail, '^((?:.|\n)*?\n)(?:MESSAGE \S+ SIP/2.0\r|SIP/2.0 200 OK\r)', 1)) AS hop
        FROM (
          SELECT *, length(rest) - length(ltrim(rest, chr(13) || chr(10))) AS skip, ltrim(rest, chr(13) || chr(10)) AS tail,
                 regexp_matches(ltrim(rest, chr(13) || chr(10)), '^(MESSAGE \S+ SIP/2.0\r|SIP/2.0 200 OK\r)') AS starts
          FROM r WHERE NOT over AND rest != ''))),
    f AS (SELECT r.conv_id, began, until, substring(stream, began + 1, until - began) AS payload FROM r JOIN s USING (conv_id) WHERE real)
    SELECT conv_id AS flow, row_number() OVER (PARTITION BY conv_id ORDER BY began) AS msg_no, began AS start_byte, until AS end_byte, md5(payload) AS payload_md5, began // 97 AS at_second FROM f
    """,
)
def framed_messages(spark, sf):
    """Messages framed in byte streams made of conversations."""
    stream = stage(order_stream(conversation_stream(spark, sf), ["flow"], F.col("seq")), "stream-segments")
    framed = frame_stream(stream, ["flow"], text_length)
    return framed.select("flow", "msg_no", "start_byte", "end_byte", F.md5("payload").alias("payload_md5"), F.unix_seconds("ts").alias("at_second"))


# Twenty streams of packets made of events: numbers that wrap, swapped and repeated packets, strays, and two restarts.
PACKET_SQL = """
    e AS (SELECT event_id % 20 AS stream, event_id // 20 AS i FROM events),
    p AS (
      SELECT stream, i,
             (65400 + 7 * stream + CASE WHEN i % 10 = 4 THEN i + 1 WHEN i % 10 = 5 THEN i - 1 WHEN i % 23 = 9 THEN i - 1 ELSE i END
              + CASE WHEN i > 33 THEN 45000 WHEN i > 17 THEN 20000 ELSE 0 END + CASE WHEN i % 41 = 30 THEN 30000 ELSE 0 END) % 65536 AS seq
      FROM e)
"""


def packets_of_events(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 20).alias("stream"), F.floor(F.col("event_id") / 20).alias("i"))
    i = F.col("i")
    moved = F.when(i % 10 == 4, i + 1).when(i % 10 == 5, i - 1).when(i % 23 == 9, i - 1).otherwise(i)
    restart = F.when(i > 33, 45_000).when(i > 17, 20_000).otherwise(0)
    return e.withColumn("seq", ((65_400 + 7 * F.col("stream") + moved + restart + F.when(i % 41 == 30, 30_000).otherwise(0)) % 65_536).cast("int"))


@query(
    "sequence_restarts",
    "WITH RECURSIVE" + PACKET_SQL + """,
    r AS (
      SELECT stream, i, CAST(seq AS BIGINT) AS base, CAST(seq AS BIGINT) AS high, CAST(-1 AS BIGINT) AS follows, [CAST(seq AS BIGINT)] AS seen,
             CAST(0 AS BIGINT) AS dup, CAST(0 AS BIGINT) AS ooo, CAST(0 AS BIGINT) AS resets
      FROM p WHERE i = 0
      UNION ALL
      SELECT stream, i, CASE WHEN restart THEN seq ELSE base END,
             CASE WHEN restart THEN seq WHEN step > 0 AND step < 3000 THEN high + step ELSE high END,
             CASE WHEN restart THEN -1 WHEN near THEN follows ELSE (seq + 1) % 65536 END,
             CASE WHEN restart THEN [seq] WHEN step > 0 AND step < 3000 THEN list_append(list_filter(seen, lambda x: x > high + step - 100), high + step)
                  WHEN near THEN list_append(seen, high + step) ELSE seen END,
             dup + CAST(step <= 0 AND near AND list_contains(seen, high + step) AS BIGINT),
             ooo + CAST((step <= 0 AND near AND NOT list_contains(seen, high + step)) OR (NOT near AND NOT restart) AS BIGINT),
             resets + CAST(restart AS BIGINT)
      FROM (
        SELECT *, step > -100 AND step < 3000 AS near, NOT (step > -100 AND step < 3000) AND seq = follows AS restart
        FROM (
          SELECT p.stream, p.i, CAST(p.seq AS BIGINT) AS seq, ((p.seq - r.high % 65536 + 98304) % 65536) - 32768 AS step, r.* EXCLUDE (stream, i)
          FROM r JOIN p ON p.stream = r.stream AND p.i = r.i + 1))),
    z AS (SELECT stream, max(i) AS i FROM p GROUP BY stream),
    f AS (SELECT stream, i + 1 AS packets, high - base + 1 AS span, dup, ooo, resets FROM r JOIN z USING (stream, i))
    SELECT stream, packets, greatest(span, packets - dup) AS expected, dup AS duplicates, ooo AS out_of_order, resets,
           greatest(0, greatest(span, packets - dup) - (packets - dup)) AS lost
    FROM f
    """,
)
def sequence_restarts(spark, sf):
    """Sequence accounting under the restart rule; every stream has strays and may restart twice."""
    out = sequence_accounting(packets_of_events(spark, sf), ["stream"], ["i"], "seq")
    return out.select("stream", "packets", "expected", "duplicates", "out_of_order", "resets", "lost")


@query(
    "reassembled_datagrams",
    r"""
    WITH t AS (
      SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS text FROM conversations),
    f AS (SELECT *, CAST(ceil(length(text) / 64.0) AS BIGINT) AS n FROM t WHERE text != '')
    SELECT conv_id AS src, turn % 2 AS ip_id, turn * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 100 END AS at_second, n AS n_fragments, CAST(length(text) AS INTEGER) AS size, md5(text) AS payload_md5
    FROM f WHERE NOT (conv_id % 2 = 1 AND turn % 5 = 4 AND n > 1)
    """,
)
def reassembled_datagrams(spark, sf):
    """Turns as datagrams of 64-byte fragments that come last one first; ids repeat within seconds, or some fragments are lost."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    t = table(spark, sf, "conversations").select("conv_id", "turn", plain.alias("text")).where("text != ''")
    last = F.ceil(F.length("text") / 64).cast("int") - 1
    cut = t.withColumn("last", last).withColumn("i", F.explode(F.sequence(F.lit(0), "last")))
    odd = F.col("conv_id") % 2 == 1
    second = F.col("turn") * F.when(odd, 100).otherwise(1)
    fragments = cut.where(~(odd & (F.col("turn") % 5 == 4) & (F.col("last") > 0) & (F.col("i") == 0))).select(
        F.col("conv_id").alias("src"), (F.col("turn") % 2).alias("ip_id"), (F.col("i") * 64).alias("off"), (F.col("i") < F.col("last")).alias("more"),
        F.encode(F.substr("text", F.col("i") * 64 + 1, F.lit(64)), "ISO-8859-1").alias("data"), F.timestamp_seconds(second + (F.col("last") - F.col("i")) / 1e6).alias("ts"), F.lit(64).alias("wire_bytes"),
    )
    whole, _ = reassemble_fragments(fragments, ["src", "ip_id"])
    return whole.select("src", "ip_id", F.unix_seconds("ts").alias("at_second"), "n_fragments", "size", F.md5("payload").alias("payload_md5"))


@query(
    "multipart_media",
    """
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '2' ELSE '2.2' END AS sdp_path, CASE turn % 3 WHEN 0 THEN 1 ELSE 2 + CAST(turn % 3 = 2 AS INT) END AS n_parts,
           CAST(10000 + turn AS INTEGER) AS port, CASE WHEN conv_id % 2 = 0 THEN 'opus' ELSE 'AMR-WB' END AS codec
    FROM conversations
    """,
)
def multipart_media(spark, sf):
    """Media of messages whose session description is the body, a part of it, or a part of a part."""
    eol = "\r\n"
    codec = F.when(F.col("conv_id") % 2 == 0, "opus").otherwise("AMR-WB")
    sdp = F.concat(F.lit(f"v=0{eol}c=IN IP4 192.0.2.1{eol}m=audio "), (F.lit(10_000) + F.col("turn")).cast("string"), F.lit(f" RTP/AVP 96{eol}a=rtpmap:96 "), codec, F.lit(f"/48000{eol}"))
    part = lambda b, kind, body: F.concat(F.lit(f"--{b}{eol}Content-Type: {kind}{eol}{eol}"), body, F.lit(eol))
    both = lambda b, x, y: F.concat(x, y, F.lit(f"--{b}--{eol}"))
    text = part("b1", "text/plain", F.lit("--b1x no delimiter"))
    flat = both("b1", text, part("b1", "application/sdp", sdp))
    inner = both("b1x", part("b1x", "application/isup;version=1", F.lit("IAM")), part("b1x", "application/sdp", sdp))
    nested = both("b1", text, part("b1", f'multipart/mixed;{eol} boundary="b1x"', inner))
    kind = F.when(F.col("turn") % 3 == 0, "application/sdp").otherwise("multipart/mixed; boundary=b1")
    body = F.when(F.col("turn") % 3 == 0, sdp).when(F.col("turn") % 3 == 1, flat).otherwise(nested)
    raw = F.concat(F.lit(f"INVITE sip:a@b SIP/2.0{eol}Call-ID: x{eol}Content-Type: "), kind, F.lit(eol + eol), body)
    parsed = parse_messages(table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw")))
    parts = body_parts(F.col("body"), header(F.col("headers"), "content-type"))
    media = F.col("sdp.media")[0]
    at = F.filter("parts", lambda p: p["part_type"] == "application/sdp")[0]["path"]
    return parsed.withColumn("parts", parts).select(
        "conv_id", "turn", at.alias("sdp_path"), F.size("parts").alias("n_parts"), media["port"].alias("port"), media["payloads"][0]["codec"].alias("codec")
    )
