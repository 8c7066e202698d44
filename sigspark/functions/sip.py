"""Parsing of text signalling messages with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One-letter header names and what they stand for.
COMPACT = {
    "a": "accept-contact", "b": "referred-by", "c": "content-type", "d": "request-disposition",
    "e": "content-encoding", "f": "from", "i": "call-id", "j": "reject-contact", "k": "supported",
    "l": "content-length", "m": "contact", "o": "event", "r": "refer-to", "s": "subject", "t": "to",
    "u": "allow-events", "v": "via", "x": "session-expires", "y": "identity",
}

# Payload types with a static meaning (RFC 3551).
STATIC_PAYLOADS = {
    0: ("PCMU", 8000), 3: ("GSM", 8000), 4: ("G723", 8000), 8: ("PCMA", 8000), 9: ("G722", 8000),
    15: ("G728", 8000), 18: ("G729", 8000), 26: ("JPEG", 90000), 31: ("H261", 90000),
    34: ("H263", 90000),
}

REQUEST = r"^([A-Za-z][A-Za-z0-9.!%*_+`'~-]*)\s+(\S+)\s+SIP/\d+\.\d+\s*$"
STATUS = r"^SIP/\d+\.\d+\s+(\d{3})\s?(.*)$"


def canonical(name: Column) -> Column:
    """Lower-case long name of a header."""
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in COMPACT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), low)


def unfold(raw: Column) -> Column:
    """Line ends made uniform, continuation lines joined to the line before."""
    lines = F.regexp_replace(raw, r"\r\n?", "\n")
    head = F.regexp_replace(F.substring_index(lines, "\n\n", 1), r"\n[ \t]+", " ")
    return head


def body_of(raw: Column) -> Column:
    lines = F.regexp_replace(raw, r"\r\n?", "\n")
    at = F.locate("\n\n", lines)
    return F.when(at > 0, F.substring(lines, at + 2, F.length(lines)))


def parse_headers(raw: Column) -> Column:
    """``ARRAY<STRUCT<name,value>>`` in order, names as written."""
    split = F.split(unfold(raw), "\n")
    lines = F.slice(split, F.lit(2), F.size(split))
    parsed = F.transform(
        F.filter(lines, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("name"),
            F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value"),
        ),
    )
    return parsed


def headers(hs: Column, name: str) -> Column:
    """All values of one header."""
    hit = F.filter(hs, lambda h: canonical(h["name"]) == name.lower())
    return F.transform(hit, lambda h: F.coalesce(h["value"], F.lit("")))


def header(hs: Column, name: str) -> Column:
    """First value of one header, null when absent."""
    return F.try_element_at(headers(hs, name), F.lit(1))


def has_header(hs: Column, name: str) -> Column:
    return F.coalesce(F.exists(hs, lambda h: canonical(h["name"]) == name.lower()), F.lit(False))


def split_quoted(value: Column) -> Column:
    """Split on commas that stand outside quotes and angle brackets."""
    parts = F.split(value, r',(?=(?:[^"]*"[^"]*")*[^"]*$)(?![^<]*>)')
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def option_tags(values: Column) -> Column:
    """Lower-case tokens of comma-separated option lists."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    return F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def uri_of(value: Column) -> Column:
    bracketed = F.regexp_extract(value, r"<([^>]*)>", 1)
    bare = F.trim(F.substring_index(value, ";", 1))
    return F.when(bracketed != "", bracketed).when(bare != "", bare)


def uri_user(uri: Column) -> Column:
    """User part of a sip, sips or tel URI or of an address holding one."""
    inner = F.coalesce(F.nullif(F.regexp_extract(uri, r"<([^>]*)", 1), F.lit("")), uri)
    sip = F.regexp_extract(inner, r"(?i)^\s*sips?:([^@;?\s]+)@", 1)
    tel = F.regexp_extract(inner, r"(?i)^\s*tel:([^;?\s]+)", 1)
    return F.when(sip != "", sip).when(tel != "", tel)


def uri_host(uri: Column) -> Column:
    host = F.regexp_extract(uri, r"(?i)sips?:(?:[^@;>\s]*@)?(\[[^\]]+\]|[^;>,\s:?]+)", 1)
    return F.nullif(F.regexp_replace(host, r"[\[\]]", ""), F.lit(""))


def tag_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(?i);\s*tag\s*=\s*([^;\s>]+)", 1), F.lit(""))


def display_of(value: Column) -> Column:
    quoted = F.regexp_extract(value, r'^\s*"([^"]*)"', 1)
    plain = F.trim(F.regexp_extract(value, r"^([^<\"]*)<", 1))
    return F.when(quoted != "", quoted).when(plain != "", plain)


def address_parts(value: Column) -> Column:
    """STRUCT<uri,user,host,tag,display> of a From/To/Contact value."""
    uri = uri_of(value)
    return F.struct(
        uri.alias("uri"),
        uri_user(uri).alias("user"),
        uri_host(uri).alias("host"),
        tag_of(value).alias("tag"),
        display_of(value).alias("display"),
    )


def via_host(via: Column) -> Column:
    host = F.regexp_extract(via, r"(?i)SIP\s*/\s*\d+\.\d+\s*/\s*[A-Z0-9]+\s+(\[[^\]]+\]|[^;,\s:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"[\[\]]", ""), F.lit(""))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def with_start_line(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add is_request, method, request_uri, status, reason and the parsed header list."""
    line = F.trim(F.substring_index(F.regexp_replace(F.col(raw), r"^[\r\n]+", ""), "\n", 1))
    line = F.regexp_replace(line, r"\r$", "")
    out = df.withColumn("_line", line).withColumn("headers", parse_headers(F.col(raw)))
    status = F.regexp_extract("_line", STATUS, 1)
    cseq = header(F.col("headers"), "cseq")
    return (
        out.withColumn("is_request", status == "")
        .withColumn("status", F.nullif(status, F.lit("")).try_cast("int"))
        .withColumn("reason", F.nullif(F.regexp_extract("_line", STATUS, 2), F.lit("")))
        .withColumn("request_uri", F.nullif(F.regexp_extract("_line", REQUEST, 2), F.lit("")))
        .withColumn(
            "cseq",
            F.struct(
                F.regexp_extract(cseq, r"^\s*(\d+)", 1).try_cast("bigint").alias("num"),
                F.nullif(F.regexp_extract(cseq, r"^\s*\d+\s+(\S+)", 1), F.lit("")).alias("method"),
            ),
        )
        .withColumn(
            "method",
            F.when(F.col("is_request"), F.nullif(F.regexp_extract("_line", REQUEST, 1), F.lit("")))
            .otherwise(F.col("cseq")["method"]),
        )
        .drop("_line")
    )


def parse_messages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Fill the message columns of ``schemas.MESSAGES`` from the raw text."""
    out = with_start_line(df, raw)
    hs = F.col("headers")
    vias = F.flatten(F.transform(headers(hs, "via"), split_quoted))
    frm, to = header(hs, "from"), header(hs, "to")
    out = (
        out.withColumn("call_id", header(hs, "call-id"))
        .withColumn("from_uri", uri_of(frm))
        .withColumn("from_tag", tag_of(frm))
        .withColumn("to_uri", uri_of(to))
        .withColumn("to_tag", tag_of(to))
        .withColumn("vias", vias)
        .withColumn("branch", F.nullif(F.regexp_extract(F.try_element_at(F.col("vias"), F.lit(1)), r"(?i);\s*branch\s*=\s*([^;\s,]+)", 1), F.lit("")))
        .withColumn("routes", F.flatten(F.transform(headers(hs, "route"), split_quoted)))
        .withColumn("record_routes", F.flatten(F.transform(headers(hs, "record-route"), split_quoted)))
        .withColumn("contact", header(hs, "contact"))
        .withColumn("body_type", F.lower(F.trim(F.substring_index(header(hs, "content-type"), ";", 1))))
        .withColumn("body", body_of(F.col(raw)))
        .withColumn("size", F.octet_length(raw).cast("int"))
    )
    described = F.col("body_type").isin("application/sdp") | F.col("body_type").startswith("multipart/")
    out = out.withColumn("_sdp", F.when(described, sdp_text(F.col("body"), header(hs, "content-type"))))
    return out.withColumn("sdp", F.when(F.col("_sdp").isNotNull(), parse_sdp(F.col("_sdp")))).drop("_sdp")


def _attr(lines: Column, prefix: str) -> Column:
    hit = F.filter(lines, lambda x: x.startswith(prefix))
    return F.try_element_at(F.transform(hit, lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x))), F.lit(1))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda variable is bound, not copied."""
    return F.element_at(F.transform(F.array(value), use), 1)


DIRECTIONS = ["a=sendrecv", "a=sendonly", "a=recvonly", "a=inactive"]


def parse_sdp(body: Column) -> Column:
    """STRUCT of origin, connection, session attributes and media, built without a UDF.

    The body is cut before every m= line; the first piece is the session part.
    """
    text = F.regexp_replace(body, r"\r\n?", "\n")
    pieces = F.transform(F.split(text, r"\n(?=m=)"), lambda p: F.split(p, "\n"))
    return _let(pieces, _sdp_struct)


def _sdp_struct(pieces: Column) -> Column:
    session = pieces[0]
    session_dir = F.try_element_at(F.filter(session, lambda x: x.isin(DIRECTIONS)), F.lit(1))
    conn = F.try_element_at(F.split(_attr(session, "c="), r"\s+"), F.lit(3))
    origin = _let(
        F.split(_attr(session, "o="), r"\s+"),
        lambda o: F.when(
            o.isNotNull(),
            F.struct(
                F.try_element_at(o, F.lit(1)).alias("user"),
                F.try_element_at(o, F.lit(2)).alias("sess_id"),
                F.try_element_at(o, F.lit(3)).alias("sess_version"),
                F.try_element_at(o, F.lit(6)).alias("addr"),
            ),
        ),
    )
    parts = F.transform(
        F.filter(pieces, lambda lines: F.element_at(lines, 1).startswith("m=")),
        lambda lines: F.struct(
            F.split(F.regexp_replace(F.element_at(lines, 1), "^m=", ""), r"\s+").alias("m"),
            F.filter(lines, lambda x: x.startswith("a=")).alias("attrs"),
            F.try_element_at(F.split(_attr(lines, "c="), r"\s+"), F.lit(3)).alias("conn"),
        ),
    )
    head = F.struct(
        origin.alias("origin"), conn.alias("conn"), session_dir.alias("dir"),
        F.filter(session, lambda x: x.startswith("a=")).alias("attrs"), parts.alias("parts"),
    )
    return _let(head, _sdp_result)


def _sdp_result(h: Column) -> Column:
    first_conn = F.try_element_at(F.filter(F.transform(h["parts"], lambda p: p["conn"]), lambda x: x.isNotNull()), F.lit(1))
    return F.struct(
        h["origin"].alias("origin"),
        F.coalesce(h["conn"], first_conn).alias("connection"),
        h["attrs"].alias("session_attrs"),
        F.transform(h["parts"], lambda p: _sdp_media(p, h["dir"])).alias("media"),
    )


def _sdp_media(part: Column, session_dir: Column) -> Column:
    m, attrs = part["m"], part["attrs"]
    direction = F.try_element_at(F.filter(attrs, lambda x: x.isin(DIRECTIONS)), F.lit(1))
    types = F.filter(F.slice(m, F.lit(4), F.greatest(F.size(m), F.lit(0))), lambda x: x.rlike(r"^\d+$"))
    named = F.transform(
        types,
        lambda p: F.struct(
            p.try_cast("int").alias("pt"),
            F.split(F.trim(F.substring_index(_payload_line(attrs, "a=rtpmap:", p), " ", -1)), "/").alias("map"),
            F.regexp_replace(_payload_line(attrs, "a=fmtp:", p), r"^a=fmtp:\d+ ", "").alias("fmtp"),
        ),
    )
    return F.struct(
        F.try_element_at(m, F.lit(1)).alias("type"),
        F.regexp_extract(F.try_element_at(m, F.lit(2)), r"^(\d+)", 1).try_cast("int").alias("port"),
        F.try_element_at(m, F.lit(3)).alias("proto"),
        _attr(attrs, "a=ptime:").try_cast("int").alias("ptime"),
        F.substring(F.coalesce(direction, session_dir, F.lit("a=sendrecv")), 3, 20).alias("direction"),
        attrs.alias("attrs"),
        F.transform(named, _sdp_payload).alias("payloads"),
    )


def _payload_line(attrs: Column, prefix: str, pt: Column) -> Column:
    """The attribute line of one payload type, matched up to the blank after it."""
    start = F.concat(F.lit(prefix), pt, F.lit(" "))
    return F.try_element_at(F.filter(attrs, lambda a: a.startswith(start)), F.lit(1))


def _sdp_payload(p: Column) -> Column:
    codec, rate = F.lit(None).cast("string"), F.lit(None).cast("int")
    for pt, (name, hz) in STATIC_PAYLOADS.items():
        codec = F.when(p["pt"] == pt, name).otherwise(codec)
        rate = F.when(p["pt"] == pt, hz).otherwise(rate)
    return F.struct(
        p["pt"].alias("pt"),
        F.coalesce(F.try_element_at(p["map"], F.lit(1)), codec).alias("codec"),
        F.coalesce(F.try_element_at(p["map"], F.lit(2)).try_cast("int"), rate).alias("rate"),
        p["fmtp"].alias("fmtp"),
    )


def explode_sdp(df: DataFrame, keys: list[str], sdp: str = "sdp") -> tuple[DataFrame, DataFrame]:
    """(media rows, payload rows) of messages with a session description."""
    base = df.where(F.col(sdp).isNotNull()).select(*keys, F.col(sdp), F.posexplode(F.col(sdp)["media"]).alias("media_no", "m"))
    media = base.select(
        *keys, "media_no",
        F.col(sdp)["connection"].alias("connection"),
        F.col(sdp)["origin"]["addr"].alias("origin_addr"),
        F.col(sdp)["session_attrs"].alias("session_attrs"),
        "m.type", "m.port", "m.proto", "m.ptime", "m.direction", "m.attrs", "m.payloads",
    )
    payloads = media.select(*keys, "media_no", "type", F.posexplode("payloads").alias("payload_no", "p")).select(
        *keys, "media_no", "type", "payload_no", "p.pt", "p.codec", "p.rate", "p.fmtp"
    )
    return media, payloads


PART = "struct<path:string,part_type:string,disposition:string,boundary:string,body:string>"


def _part(path: Column, head: Column, body: Column) -> Column:
    """One part from its header block, folded lines taken together."""
    flat = F.regexp_replace(head, r"\n[ \t]+", " ")
    value = F.regexp_extract(flat, r"(?im)^content-type[ \t]*:[ \t]*(.*)$", 1)
    return _let(value, lambda v: F.struct(
        path.alias("path"), F.lower(F.regexp_extract(v, r"^([^;\s]+)", 1)).alias("part_type"),
        F.lower(F.regexp_extract(flat, r"(?im)^content-disposition[ \t]*:[ \t]*([^;\s]+)", 1)).alias("disposition"), _boundary(v).alias("boundary"), body.alias("body"),
    ))


def _boundary(content_type: Column) -> Column:
    quoted = F.regexp_extract(content_type, r'(?i);\s*boundary\s*=\s*"([^"]+)"', 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(content_type, r'(?i);\s*boundary\s*=\s*([^;\s"]+)', 1))


def _children(p: Column) -> Column:
    """The parts of a container: what stands between its delimiter lines, up to the closing one."""
    # \Q..\E takes the boundary literally
    literal = F.replace(p["boundary"], F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split(F.concat(F.lit("\n"), p["body"]), F.concat(F.lit("\n--\\Q"), literal, F.lit("\\E(?=--|[ \t]*(?:\n|$))")))

    def inside(all_pieces):
        closing = F.array_position(F.transform(all_pieces, lambda x: x.startswith("--")), F.lit(True))
        last = F.when(closing > 0, closing - 1).otherwise(F.size(all_pieces))
        return F.slice(all_pieces, F.lit(2), F.greatest(last - 1, F.lit(0)).cast("int"))

    def one(piece, i):
        path = F.concat_ws(".", F.nullif(p["path"], F.lit("")), (i + 1).cast("string"))
        text = F.regexp_replace(piece, r"^[ \t]*\n", "")
        gap = F.position(F.lit("\n\n"), text)
        bare = text.startswith("\n")
        head = F.when(bare, "").when(gap > 0, F.substr(text, F.lit(1), gap)).otherwise(text)
        body = F.when(bare, F.substr(text, F.lit(2))).when(gap > 0, F.substr(text, gap + 2)).otherwise("")
        return _part(path, head, body)

    return F.transform(_let(pieces, inside), one)


def body_parts(body: Column, content_type: Column) -> Column:
    """ARRAY<STRUCT<path,part_type,disposition,boundary,body>>: the parts of a body, containers within containers opened.

    A body that is no container is one part with an empty path; parts of a container are "1", "2", those of the second one "2.1" and
    so on. Containers are opened level by level, as often as the text names one.
    """
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n")
    whole = F.array(_part(F.lit(""), F.concat(F.lit("Content-Type: "), F.coalesce(content_type, F.lit(""))), text).cast(PART))
    box = lambda p: p["part_type"].startswith("multipart/") & (p["boundary"] != "")
    # no more levels than boundaries are named
    levels = F.size(F.regexp_extract_all(F.concat(F.coalesce(content_type, F.lit("")), text), F.lit(r"(?i)(boundary)"), F.lit(1)))
    opened = lambda parts: F.flatten(F.transform(parts, lambda p: F.when(box(p), _children(p).cast(f"array<{PART}>")).otherwise(F.array(p))))
    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), whole, lambda parts, _: opened(parts))).otherwise(whole)


def sdp_text(body: Column, content_type: Column) -> Column:
    """The session description of a body: all of it, or the first such part of a container; null without one."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    inner = F.filter(body_parts(body, content_type), lambda p: p["part_type"] == "application/sdp")
    return F.when(kind == "application/sdp", body).when(kind.startswith("multipart/"), F.try_element_at(inner, F.lit(1))["body"])


def split_parts(df: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Container bodies to one row per part with its path, type, disposition and text."""
    parts = body_parts(F.col(body), F.col(content_type))
    rows = df.where(_boundary(F.col(content_type)) != "").select("*", F.posexplode(parts).alias("part_no", "_p"))
    return rows.select("*", F.col("_p.path").alias("part_path"), F.col("_p.part_type").alias("part_type"), F.col("_p.disposition").alias("disposition"), F.col("_p.body").alias("part_body")).drop("_p")


def rtp_header(payload: Column) -> Column:
    """STRUCT<version,pt,marker,seq,rtp_ts,ssrc> read from the fixed header; null for short or other data."""

    def number(start: int, n: int) -> Column:
        return F.conv(F.hex(F.substring(payload, start, n)), 16, 10).cast("bigint")

    first, second = number(1, 1), number(2, 1)
    ok = (F.octet_length(payload) >= 12) & (F.shiftright(first, 6) == 2)
    return F.when(
        ok,
        F.struct(
            F.shiftright(first, 6).cast("int").alias("version"),
            second.bitwiseAND(127).cast("int").alias("pt"),
            (second >= 128).alias("marker"),
            number(3, 2).cast("int").alias("seq"),
            number(5, 4).alias("rtp_ts"),
            number(9, 4).alias("ssrc"),
        ),
    )


def transaction_key(method: Column, cseq: Column, branch: Column) -> Column:
    """ACK and CANCEL belong to the transaction of the request they are about."""
    base = F.when(method.isin("ACK", "CANCEL"), F.lit("INVITE")).otherwise(method)
    return F.concat_ws("|", cseq.cast("string"), base, F.coalesce(branch, F.lit("")))


def same_party(a: Column, b: Column, min_suffix: int = 6) -> Column:
    """Two user parts name one party: equal ignoring case, or numbers equal up to prefix forms."""
    ta, tb = F.trim(a), F.trim(b)
    shape = r"^[+0-9()\-. #*]+$"

    def variants(x: Column) -> Column:
        d = digits(x)
        alt = (
            F.when((F.length(d) > 2) & d.startswith("00"), F.substring(d, 3, 100))
            .when((F.length(d) > 1) & d.startswith("0"), F.substring(d, 2, 100))
            .otherwise(d)
        )
        return F.array(d, alt)

    def tail_match(x: Column, y: Column) -> Column:
        longer_x = (F.length(x) >= F.length(y)) & (F.length(y) >= min_suffix) & x.endswith(y)
        longer_y = (F.length(y) >= F.length(x)) & (F.length(x) >= min_suffix) & y.endswith(x)
        return (x == y) | longer_x | longer_y

    numbers = F.exists(variants(ta), lambda x: F.exists(variants(tb), lambda y: tail_match(x, y)))
    numeric = ta.rlike(shape) & tb.rlike(shape) & (digits(ta) != "") & (digits(tb) != "")
    hit = (ta != "") & (tb != "") & ((F.lower(ta) == F.lower(tb)) | (numeric & numbers))
    return F.coalesce(hit, F.lit(False))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    return _common_prefix_len(F.reverse(a), F.reverse(b))


def _common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    ks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(ks, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.size(hits)
