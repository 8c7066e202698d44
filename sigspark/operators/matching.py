"""Joins of flows, names and ids with dialogs; patterns within a dialog."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.pairing import asof_next
from sigspark.session import BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT, int_conf, stage

# Needles sent to every task as one automaton, in bytes; characters of a gram for more of them.
AUTOMATON_BYTES = 16_000_000
GRAM = 6
ANY_ADDRESS = ("0.0.0.0", "::")


def without_reverse(flows: DataFrame, keys: Sequence[str], source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Flows with no flow the other way round under the same keys: an anti-join with itself swapped."""
    back = flows.select(
        *keys,
        *[F.col(t).alias(s) for s, t in zip(source, target, strict=True)],
        *[F.col(s).alias(t) for s, t in zip(source, target, strict=True)],
    ).distinct()
    return flows.join(back, [*keys, *source, *target], "left_anti")


def silent_after(starts: DataFrame, activity: DataFrame, keys, start_ts: str, activity_ts: str, start_id: str, activity_id: str, within_s: float | None = None) -> DataFrame:
    """Starts after which no activity follows (within the given time): only the next one is looked up."""
    nxt = asof_next(starts, activity, keys, start_ts, activity_ts, start_id, activity_id)
    hit = F.col("next_ts").isNotNull()
    if within_s is not None:
        hit = hit & (F.col("distance_us") <= int(within_s * 1e6))
    return nxt.where(~hit)


def sdp_endpoints(media: DataFrame, messages: DataFrame, leg_messages: DataFrame) -> DataFrame:
    """Addresses at which media is announced, one row per (endpoint, leg).

    Columns: capture_id, addr, port, strength (strong/weak), plane (rtp/rtcp), leg_id, and the media
    attributes. ``media`` are rows of ``explode_sdp`` keyed by capture_id, msg_id.
    """
    owner = leg_messages.select("capture_id", "msg_id", "leg_id")
    src = messages.select("capture_id", "msg_id", "ts", F.col("src").alias("msg_src"))
    m = media.join(owner, ["capture_id", "msg_id"], "left").join(src, ["capture_id", "msg_id"])
    m = m.where(F.col("port").between(1, 65535))
    text = F.array_join("attrs", "\n")
    session = F.array_join("session_attrs", "\n")
    given = F.regexp_extract(text, r"(?im)^a=rtcp:\s*(\d{1,5})", 1).try_cast("int")
    secure = F.upper("proto").contains("SAVP") | F.concat_ws("\n", session, text).rlike(r"(?im)^a=crypto[:\s]")
    fax = (F.col("type") == "image") & (F.lower(F.concat_ws(" ", "proto", text)).rlike("udptl|t38"))
    m = (
        m.withColumn("is_secure", secure)
        .withColumn("is_fax", fax)
        .withColumn("rtcp_port", F.when(given.between(1, 65535), given).otherwise(F.col("port") + 1))
        .withColumn("_own", F.array_distinct(F.array_compact(F.array("connection", "origin_addr"))))
    )
    strong = m.select("*", F.explode("_own").alias("addr"), F.lit("strong").alias("strength"))
    weak = m.where(~F.array_contains("_own", F.col("msg_src"))).select("*", F.col("msg_src").alias("addr"), F.lit("weak").alias("strength"))
    both = strong.unionByName(weak).where(~F.col("addr").isin(*ANY_ADDRESS))
    rtp = both.withColumn("plane", F.lit("rtp"))
    rtcp = both.withColumn("plane", F.lit("rtcp")).withColumn("port", F.col("rtcp_port"))
    return rtp.unionByName(rtcp).drop("_own", "rtcp_port", "msg_src")


def match_endpoints(streams: DataFrame, endpoints: DataFrame, keys: Sequence[str], plane: str = "rtp") -> DataFrame:
    """(keys, leg_id, side, weak) bridge rows of flows and the dialogs that announced them.

    The announced address counts; the address a message came from counts only for flows that match
    nothing announced on either side. Control flows also match the media port (multiplexed).
    """
    keys = list(keys)
    ends = F.explode(F.array(
        F.struct(F.lit("dst").alias("side"), F.col("dst").alias("addr"), F.col("dport").alias("port")),
        F.struct(F.lit("src").alias("side"), F.col("src").alias("addr"), F.col("sport").alias("port")),
    ))
    own = [k for k in keys if k != "capture_id"]
    flows = streams.select("capture_id", *own, ends.alias("e")).select("capture_id", *own, "e.*")
    planes = ["rtp"] if plane == "rtp" else ["rtcp", "rtp"]
    marks = endpoints.where(F.col("plane").isin(planes) | (F.col("strength") == "weak"))
    marks = marks.select("capture_id", "addr", "port", "strength", "leg_id").distinct()
    hits = flows.join(marks, ["capture_id", "addr", "port"]).select("capture_id", *own, "side", "strength", "leg_id").distinct()
    strong = hits.where(F.col("strength") == "strong")
    weak = hits.where(F.col("strength") == "weak").join(strong.select("capture_id", *own).distinct(), ["capture_id", *own], "left_anti")
    return strong.unionByName(weak).select(*keys, "leg_id", "side", (F.col("strength") == "weak").alias("weak"))


def stream_formats(streams: DataFrame, endpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Announced codec and clock per stream and payload type; the destination side is preferred."""
    own = [k for k in keys if k != "capture_id"]
    pt = endpoints.where(F.col("plane") == "rtp").select(
        "capture_id", "addr", "port", "strength", "ts", "is_secure", "is_fax", F.explode_outer("payloads").alias("p")
    )
    ends = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("dst").alias("addr"), F.col("dport").alias("port")),
        F.struct(F.lit(1).alias("side"), F.col("src").alias("addr"), F.col("sport").alias("port")),
    ))
    flows = streams.select("capture_id", *own, ends.alias("e")).select("capture_id", *own, "e.*")
    rank = F.struct(F.when(F.col("strength") == "strong", 0).otherwise(1).alias("w"), F.col("side"), F.col("ts"))
    return flows.join(pt, ["capture_id", "addr", "port"]).groupBy("capture_id", *own, F.col("p.pt").alias("pt")).agg(
        F.min_by("p.codec", rank).alias("codec"), F.min_by("p.rate", rank).alias("rate"),
        F.max(F.col("is_secure").cast("int")).cast("boolean").alias("is_secure"),
        F.max(F.col("is_fax").cast("int")).cast("boolean").alias("is_fax"),
    )


def ice_keys(media: DataFrame, leg_messages: DataFrame) -> DataFrame:
    """(capture_id, kind, key, leg_id): endpoints, candidate addresses and user fragments of dialogs."""
    m = media.join(leg_messages.select("capture_id", "msg_id", "leg_id"), ["capture_id", "msg_id"])
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("attrs", none), F.coalesce("session_attrs", none))
    attrs = m.select("capture_id", "leg_id", F.explode(F.transform(every, lambda a: F.regexp_replace(a, "^a=", ""))).alias("a"))
    cand = r"(?i)^candidate:\S+\s+\d+\s+\S+\s+\d+\s+(\S+)\s+(\d+)"
    media_ends = m.where(F.col("port").isNotNull()).select(
        "capture_id", F.lit("endpoint").alias("kind"),
        F.concat_ws(":", F.coalesce("connection", "origin_addr"), F.col("port").cast("string")).alias("key"), "leg_id",
    )
    cands = attrs.where(F.col("a").rlike(cand)).select(
        "capture_id", F.lit("endpoint").alias("kind"),
        F.concat_ws(":", F.regexp_extract("a", cand, 1), F.regexp_extract("a", cand, 2)).alias("key"), "leg_id",
    )
    frags = attrs.where(F.col("a").rlike(r"(?i)^ice-ufrag:\S+")).select(
        "capture_id", F.lit("ufrag").alias("kind"), F.regexp_extract("a", r"(?i)^ice-ufrag:(\S+)", 1).alias("key"), "leg_id"
    )
    return media_ends.unionByName(cands).unionByName(frags).distinct()


def match_keys(flows: DataFrame, keys_of_legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flows (with src, sport, dst, dport and username) to dialogs by endpoint or either half of the
    user name; one row per (flow, dialog)."""
    own = [k for k in keys if k != "capture_id"]
    ends = F.array(
        F.struct(F.lit("endpoint").alias("kind"), F.concat_ws(":", "src", F.col("sport").cast("string")).alias("key")),
        F.struct(F.lit("endpoint").alias("kind"), F.concat_ws(":", "dst", F.col("dport").cast("string")).alias("key")),
    )
    halves = F.transform(
        F.split(F.coalesce("username", F.lit("")), ":"), lambda u: F.struct(F.lit("ufrag").alias("kind"), u.alias("key"))
    )
    named = flows.select("capture_id", *own, F.explode(F.concat(ends, halves)).alias("k")).select("capture_id", *own, "k.kind", "k.key")
    return named.distinct().join(keys_of_legs, ["capture_id", "kind", "key"]).select(*keys, "leg_id").distinct()


def match_containment(needles: DataFrame, hays: DataFrame, needle: str, hay: str, min_len: int = 1) -> DataFrame:
    """Distinct (scope, needle, hay) where the needle occurs in the hay. ``needles`` and ``hays`` have a scope column ``capture_id``.

    Needles whose number and bytes were counted to be small go to every task as one automaton (Aho-Corasick), which reads each
    hay once; nothing is shuffled but the answer. More needles meet the hays by a join on one of their character grams, the one that
    the fewest hays of the scope have, and are then looked for in full. Hays may be of any length.
    """
    n = needles.select("capture_id", F.col(needle).alias("_needle")).where((F.length("_needle") >= max(min_len, 1)) & F.col("capture_id").isNotNull()).distinct()
    h = hays.select("capture_id", F.col(hay).alias("_hay")).where((F.length("_hay") >= max(min_len, 1)) & F.col("capture_id").isNotNull()).distinct()
    n = stage(n, "needles")
    size = n.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_needle") + F.octet_length(F.col("capture_id").cast("string"))), F.lit(0)).alias("bytes")).first()
    small = size.n <= int_conf(n.sparkSession, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT) and size.bytes <= AUTOMATON_BYTES
    found = _by_automaton(n, h) if small else _by_rarest_gram(n, h)
    return found.select("capture_id", F.col("_needle").alias(needle), F.col("_hay").alias(hay))


def _by_automaton(n: DataFrame, h: DataFrame) -> DataFrame:
    scopes: dict[str, set] = {}
    for r in n.collect():  # counted before
        scopes.setdefault(r["_needle"], set()).add(r["capture_id"])
    sent = n.sparkSession.sparkContext.broadcast(scopes)
    kind = h.schema["capture_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = sent.value
        machine = ahocorasick.Automaton()
        for word in known:
            machine.add_word(word, word)
        if not known:
            return
        machine.make_automaton()
        for batch in batches:
            row, word = [], []
            for i, (scope, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                hits = sorted(w for w in {w for _, w in machine.iter(text)} if scope in known[w])
                row += [i] * len(hits)
                word += hits
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(word, pa.string()), batch.column(1).take(take)], names=["capture_id", "_needle", "_hay"])

    return h.select("capture_id", "_hay").mapInArrow(run, f"capture_id {kind}, _needle string, _hay string")


def _by_rarest_gram(n: DataFrame, h: DataFrame) -> DataFrame:
    def grams(text: str, length: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
        return F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length))))

    # a needle shorter than a gram is a gram of its own length
    own = F.least(F.length("_needle"), F.lit(GRAM))
    lengths = [r[0] for r in n.select(own.alias("len")).distinct().collect()]  # GRAM at most
    h = stage(h, "hays")
    parts = [h.where(F.length("_hay") >= k).select("capture_id", "_hay", grams("_hay", F.lit(k)).alias("_gram")) for k in sorted(lengths)]
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    often = pieces.groupBy("capture_id", "_gram").agg(F.count(F.lit(1)).alias("_often"))
    asked = n.select("capture_id", "_needle", grams("_needle", own).alias("_gram")).join(often, ["capture_id", "_gram"], "left")
    # a needle with a gram that no hay has occurs nowhere
    rare = asked.groupBy("capture_id", "_needle").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("o"), "_gram")).alias("r")).where("r.o > 0")
    met = rare.select("capture_id", "_needle", F.col("r._gram").alias("_gram")).join(pieces, ["capture_id", "_gram"])
    return met.where(F.contains("_hay", "_needle")).select("capture_id", "_needle", "_hay")


def names_to_legs(exchanges: DataFrame, messages: DataFrame, leg_messages: DataFrame, name: str = "qname") -> DataFrame:
    """(capture_id, name, leg_id): looked-up names that occur in the addresses of a dialog, whole or
    without their leading service labels."""
    q = F.lower(F.regexp_replace(F.col(name), r"\.$", ""))
    names = exchanges.select("capture_id", F.col(name), q.alias("_q")).where(F.length("_q") > 0).distinct()
    base = F.nullif(F.regexp_replace("_q", r"^(?:_[^.]*\.)+", ""), F.col("_q"))
    forms = names.select("capture_id", name, F.explode(F.array_compact(F.array(F.col("_q"), base))).alias("form"))
    text = F.lower(F.concat_ws(" ", "request_uri", "to_uri", "contact", F.array_join(F.coalesce("routes", F.array().cast("array<string>")), " ")))
    # a name can only occur within a run of name characters
    words = messages.select("capture_id", "msg_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z0-9._-]+"), F.lit(0)))).alias("word"))
    owner = words.join(leg_messages.select("capture_id", "msg_id", "leg_id"), ["capture_id", "msg_id"]).select("capture_id", "leg_id", "word").distinct()
    found = match_containment(forms, owner, "form", "word")
    return (
        found.join(forms, ["capture_id", "form"]).join(owner, ["capture_id", "word"])
        .select("capture_id", name, "leg_id").distinct()
    )


def link_ids(left: DataFrame, right: DataFrame, left_id: str, right_id: str, min_len: int = 8) -> DataFrame:
    """(capture_id, left_id, right_id, how): equal ignoring case, else one contained in the other.

    Only ids without an exact partner go on to containment, in both directions.
    """
    a = left.select("capture_id", F.col(left_id)).where(F.length(left_id) > 0).distinct().withColumn("_a", F.lower(left_id))
    b = right.select("capture_id", F.col(right_id)).where(F.length(right_id) > 0).distinct().withColumn("_b", F.lower(right_id))
    exact = a.join(b.withColumn("_a", F.col("_b")), ["capture_id", "_a"]).select("capture_id", left_id, right_id, F.lit("exact").alias("how"))
    rest = a.join(exact.select("capture_id", left_id), ["capture_id", left_id], "left_anti")
    down = match_containment(rest, b, "_a", "_b", min_len)
    up = match_containment(b, rest, "_b", "_a", min_len)
    part = down.unionByName(up.select(*down.columns)).distinct()
    part = part.join(rest, ["capture_id", "_a"]).join(b, ["capture_id", "_b"])
    return exact.unionByName(part.select("capture_id", left_id, right_id, F.lit("substring").alias("how")))


def inherit_link(exchanges: DataFrame, own: str, request_own: str) -> DataFrame:
    """The link of an answer: its own, else that of its request."""
    return exchanges.withColumn("link", F.coalesce(own, request_own)).withColumn(
        "inherited", F.col(own).isNull() & F.col(request_own).isNotNull()
    )


def leg_pattern(leg_messages: DataFrame, keys: Sequence[str], spec: dict[str, Column]) -> DataFrame:
    """Conditional aggregates per dialog, e.g. counts of challenges; one shuffle for all of them."""
    return leg_messages.groupBy(*keys).agg(*[c.alias(n) for n, c in spec.items()])


def auth_loops(leg_messages: DataFrame, min_challenges: int = 2) -> DataFrame:
    """Methods of a dialog challenged again and again although credentials were sent."""
    from sigspark.functions.sip import has_header

    creds = has_header(F.col("headers"), "authorization") | has_header(F.col("headers"), "proxy-authorization")
    challenge = ~F.col("is_request") & F.col("status").isin(401, 407)
    base = leg_messages.withColumn("_m", F.coalesce(F.col("cseq.method"), F.col("method")))
    out = leg_pattern(base, ["capture_id", "leg_id", "_m"], {
        "n_challenges": F.sum(challenge.cast("int")),
        "n_credentialed": F.sum((F.col("is_request") & creds).cast("int")),
    })
    return out.withColumnRenamed("_m", "method").where((F.col("n_challenges") >= min_challenges) & (F.col("n_credentialed") >= 1))


def cancel_races(leg_messages: DataFrame) -> DataFrame:
    """Dialogs answered at or after their CANCEL, or canceled without the final 487."""
    invite_ok = ~F.col("is_request") & (F.col("cseq.method") == "INVITE") & F.col("status").between(200, 299)
    out = leg_pattern(leg_messages, ["capture_id", "leg_id"], {
        "cancel_ts": F.min(F.when(F.col("is_request") & (F.col("method") == "CANCEL"), F.col("ts"))),
        "last_ok_ts": F.max(F.when(invite_ok, F.col("ts"))),
        "n_487": F.sum((~F.col("is_request") & (F.col("status") == 487)).cast("int")),
    }).where(F.col("cancel_ts").isNotNull())
    race = F.coalesce(F.col("last_ok_ts") >= F.col("cancel_ts"), F.lit(False))
    return out.withColumn("answered_after_cancel", race).where(race | (F.col("n_487") == 0))


def transfer_failures(leg_messages: DataFrame) -> DataFrame:
    """Dialogs whose REFER was refused, or whose progress report says it failed."""
    refer = ~F.col("is_request") & (F.col("cseq.method") == "REFER") & (F.col("status") >= 300)
    frag = F.regexp_extract(F.coalesce("body", F.lit("")), r"^SIP/2\.0 (\d{3})", 1).try_cast("int")
    bad = F.col("is_request") & (F.col("method") == "NOTIFY") & (F.coalesce("body_type", F.lit("")).contains("sipfrag")) & (frag >= 300)
    out = leg_pattern(leg_messages, ["capture_id", "leg_id"], {
        "refer_status": F.max(F.when(refer, F.col("status"))),
        "sipfrag_status": F.max(F.when(bad, frag)),
    })
    return out.where(F.col("refer_status").isNotNull() | F.col("sipfrag_status").isNotNull())


def ack_targets(leg_messages: DataFrame) -> DataFrame:
    """Answered INVITEs whose ACK goes elsewhere than the Contact of the answer, without a Route."""
    from sigspark.functions.sip import uri_host

    base = leg_messages.withColumn("cseq_num", F.col("cseq.num"))
    ok = base.where(~F.col("is_request") & (F.col("cseq.method") == "INVITE") & F.col("status").between(200, 299))
    ok = ok.groupBy("capture_id", "leg_id", "cseq_num").agg(F.min_by(uri_host(F.col("contact")), F.struct("ts", "ord")).alias("contact_host"))
    ack = base.where(F.col("is_request") & (F.col("method") == "ACK")).select(
        "capture_id", "leg_id", "cseq_num", F.col("msg_id").alias("ack_id"), uri_host(F.col("request_uri")).alias("ack_host"),
        (F.size(F.coalesce("routes", F.array().cast("array<string>"))) > 0).alias("routed"),
    )
    return ok.join(ack, ["capture_id", "leg_id", "cseq_num"]).where(
        ~F.col("routed") & (F.lower("contact_host") != F.lower("ack_host"))
    )
