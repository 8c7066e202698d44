"""Row-pair diff: linked records to typed change items."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.net import ips_in
from sigspark.functions.sip import canonical, header, headers, option_tags, uri_user

ITEM = "struct<tag:string,severity:string,category:string,label:string,ingress:string,egress:string>"

# Header names that change at every hop and say nothing.
NAME_IGNORE = ["via", "max-forwards", "content-length", "cseq", "call-id", "route", "record-route"]
# Header names whose value has a category of its own.
VALUE_IGNORE = ["from", "to", "contact", "session-expires", "min-se"]


@dataclass(frozen=True)
class Comparator:
    """``build(l, r)`` gives ARRAY<ITEM>, empty or null when nothing differs."""

    tag: str
    build: Callable[[Column, Column], Column]


def item(tag: str, severity: Column | str, category: str, label: Column | str, ingress: Column, egress: Column) -> Column:
    def text(x):
        return (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")

    return F.struct(
        F.lit(tag).alias("tag"), text(severity).alias("severity"), F.lit(category).alias("category"),
        text(label).alias("label"), text(ingress).alias("ingress"), text(egress).alias("egress"),
    )


def when_differs(tag: str, severity, category: str, label, cond: Callable, ingress: Callable, egress: Callable) -> Comparator:
    """One item when ``cond(l, r)`` holds."""
    return Comparator(
        tag,
        lambda a, b: F.when(cond(a, b), F.array(item(tag, severity(a, b) if callable(severity) else severity, category, label(a, b) if callable(label) else label, ingress(a, b), egress(a, b)))),
    )


def diff_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, comparators: Sequence[Comparator], keys: Sequence[str], left_id: str = "ingress", right_id: str = "egress", node: str = "leg_id") -> DataFrame:
    """Change items of each pair: all comparators in one projection, then one explode."""
    keys = list(keys)

    def side(df, pair_id, name):
        rest = [c for c in df.columns if c not in [*keys, node]]
        return df.select(*keys, F.col(node).alias(pair_id), F.struct(*rest).alias(name))

    both = pairs.join(side(left, left_id, "_l"), [*keys, left_id]).join(side(right, right_id, "_r"), [*keys, right_id])
    built = [c.build(F.col("_l"), F.col("_r")) for c in comparators]
    empty = F.array().cast(f"array<{ITEM}>")
    items = F.flatten(F.array(*[F.coalesce(b.cast(f"array<{ITEM}>"), empty) for b in built]))
    return both.select(*pairs.columns, F.explode(items).alias("i")).select(*pairs.columns, "i.*")


def promote(items: DataFrame, severities: Sequence[str] = ("warn", "crit")) -> DataFrame:
    """Change items grave enough to be findings, with their evidence as text."""
    evidence = F.concat_ws(
        " | ",
        F.when(F.col("ingress_value").isNotNull(), F.concat(F.lit("ingress: "), F.col("ingress_value"))),
        F.when(F.col("egress_value").isNotNull(), F.concat(F.lit("egress: "), F.col("egress_value"))),
    )
    return items.where(F.col("severity").isin(*severities)).withColumn("detail", evidence)


def diff_sets(a: Column, b: Column) -> Column:
    """STRUCT<removed,added,subset> of two lists of names."""
    removed, added = F.array_except(a, b), F.array_except(b, a)
    return F.struct(removed.alias("removed"), added.alias("added"), (F.size(added) == 0).alias("subset"))


# Items that one task keeps apart by call while it counts them.
ITEMS_PER_TASK = 500_000


def group_items(items: DataFrame, keys: Sequence[str], call: str, evidence: str, cap: int, about: int | None = None) -> DataFrame:
    """Items per tag, label and values: distinct calls, rows, and up to ``cap`` sample ids (display).

    ``about`` how many items there are at most, where the caller knows it; else they are counted. It decides balance only.
    """
    from sigspark.plans.slices import join_null_safe, top_per

    group = [*keys, "tag", "label", "ingress_value", "egress_value"]
    # few bytes are many items: the parts in which they are kept apart by call go by their count, not by their bytes
    about = items.count() if about is None else about
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-about // ITEMS_PER_TASK))
    apart = items.select(*dict.fromkeys([*group, call])).repartition(parts, *dict.fromkeys([*group, call]))
    total = apart.groupBy(*group).agg(F.countDistinct(call).alias("n_calls"), F.count(F.lit(1)).alias("n_items"))
    ids = top_per(items.select(*group, evidence).distinct(), group, [F.col(evidence)], cap)
    ids = ids.groupBy(*group).agg(F.sort_array(F.collect_list(evidence)).alias("sample"))
    return join_null_safe(total, ids, group)


# ---- the telephony comparators ------------------------------------------------------------------


def audio_codecs(sdp: Column) -> Column:
    """Distinct codec labels of the audio media, telephone events left out."""
    audio = F.filter(sdp["media"], lambda m: m["type"] == "audio")
    pays = F.filter(
        F.flatten(F.transform(audio, lambda m: m["payloads"])),
        lambda p: F.lower(F.coalesce(p["codec"], F.lit(""))) != "telephone-event",
    )
    name = lambda p: F.coalesce(F.upper(p["codec"]), F.concat(F.lit("PT"), p["pt"].cast("string")))
    return F.array_distinct(F.transform(pays, lambda p: F.concat_ws("/", name(p), p["rate"].cast("string"))))


def dtmf_type(sdp: Column) -> Column:
    audio = F.filter(sdp["media"], lambda m: m["type"] == "audio")
    te = F.filter(
        F.flatten(F.transform(audio, lambda m: m["payloads"])),
        lambda p: F.lower(F.coalesce(p["codec"], F.lit(""))) == "telephone-event",
    )
    return F.try_element_at(te, F.lit(1))["pt"]


def audio_ptime(sdp: Column) -> Column:
    timed = F.filter(sdp["media"], lambda m: (m["type"] == "audio") & m["ptime"].isNotNull())
    return F.try_element_at(timed, F.lit(1))["ptime"]


def has_fax(sdp: Column, body: Column) -> Column:
    image = F.exists(sdp["media"], lambda m: m["type"] == "image")
    return F.coalesce(image | body.rlike(r"(?i)\bt38\b"), F.lit(False))


def header_map(hs: Column) -> Column:
    """ARRAY<STRUCT<name,display,values>> of the comparable headers."""
    kept = F.filter(
        F.transform(hs, lambda h: F.struct(canonical(h["name"]).alias("n"), h["name"].alias("d"), F.trim(F.coalesce(h["value"], F.lit(""))).alias("v"))),
        lambda h: ~h["n"].isin(NAME_IGNORE),
    )
    names = F.array_distinct(F.transform(kept, lambda h: h["n"]))
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"),
            F.element_at(F.filter(kept, lambda h: h["n"] == n), 1)["d"].alias("display"),
            F.transform(F.filter(kept, lambda h: h["n"] == n), lambda h: h["v"]).alias("values"),
        ),
    )


def rel100(hs: Column) -> Column:
    return (
        F.when(F.array_contains(option_tags(headers(hs, "require")), "100rel"), "required")
        .when(F.array_contains(option_tags(headers(hs, "supported")), "100rel"), "supported")
        .otherwise("absent")
    )


def leg_profiles(legs: DataFrame, leg_messages: DataFrame) -> DataFrame:
    """One row per call leg with what the comparators read: first request, answer, early media, fax."""
    key = ["capture_id", "leg_id"]
    inv = leg_messages.select(
        *key, F.col("msg_id").alias("invite_id"), F.col("cseq.num").alias("inv_cseq"), F.col("headers").alias("inv_headers"),
        F.col("from_uri").alias("inv_from"), F.col("to_uri").alias("inv_to"), F.col("sdp").alias("offer"), F.col("body").alias("offer_body"),
        F.col("size").alias("inv_size"), F.lower("transport").alias("inv_transport"), F.col("request_uri").alias("inv_uri"),
    )
    base = legs.where(F.col("invite_id").isNotNull()).select(*key, "invite_id", "from_user", "to_user").join(inv, [*key, "invite_id"])
    msgs = leg_messages.join(base.select(*key, "invite_id", "inv_cseq"), key)
    at = F.struct("ts", "ord")
    reply = ~F.col("is_request") & (F.col("cseq.method") == "INVITE") & (F.col("cseq.num") == F.col("inv_cseq"))
    sdp = F.col("sdp").isNotNull()
    reinvite = F.col("is_request") & (F.col("method") == "INVITE") & (F.col("cseq.num") != F.col("inv_cseq"))
    fax = reinvite & has_fax(F.col("sdp"), F.coalesce("body", F.lit("")))
    seen = msgs.groupBy(*key).agg(
        F.min_by("sdp", F.when(reply & sdp & F.col("status").isin(183, 200), at)).alias("answer"),
        F.max(F.coalesce(reply & (F.col("status") == 183) & sdp, F.lit(False))).alias("has_183_sdp"),
        F.max(F.coalesce(reply & (F.col("status") == 180) & ~sdp, F.lit(False))).alias("has_180_bare"),
        F.min_by(header(F.col("headers"), "p-early-media"), F.when(header(F.col("headers"), "p-early-media").isNotNull(), at)).alias("pem"),
        F.min(F.when(fax, F.struct(F.col("ts").alias("ts"), F.col("cseq.num").alias("cseq")))).alias("fax"),
    )
    finals = leg_messages.where(~F.col("is_request") & (F.col("cseq.method") == "INVITE") & (F.col("status") >= 200))
    finals = finals.join(seen.where(F.col("fax").isNotNull()).select(*key, "fax"), key).where(
        (F.col("cseq.num") == F.col("fax.cseq")) & (F.col("ts") >= F.col("fax.ts"))
    )
    finals = finals.groupBy(*key).agg(F.min_by("status", at).alias("fax_status"))
    out = base.join(seen, key, "left").join(finals, key, "left")
    hs = F.col("inv_headers")
    se, minse = header(hs, "session-expires"), header(hs, "min-se")
    return out.select(
        *key, "invite_id", header_map(hs).alias("hmap"), hs.alias("headers"),
        F.col("inv_from").alias("from_uri"), F.col("inv_to").alias("to_uri"),
        F.coalesce(uri_user(F.col("inv_from")), F.col("from_user")).alias("from_user"),
        F.coalesce(uri_user(F.col("inv_to")), F.col("to_user")).alias("to_user"),
        F.col("inv_transport").alias("transport"), F.col("inv_size").alias("size"), F.col("inv_uri").alias("request_uri"),
        audio_codecs(F.col("offer")).alias("codecs"), F.try_element_at(audio_codecs(F.col("answer")), F.lit(1)).alias("answered_codec"),
        audio_ptime(F.col("offer")).alias("ptime"), dtmf_type(F.col("offer")).alias("dtmf"), rel100(hs).alias("rel100"),
        F.regexp_extract(se, r"(\d+)", 1).try_cast("int").alias("se"),
        F.nullif(F.lower(F.regexp_extract(se, r"(?i)refresher\s*=\s*(uac|uas)", 1)), F.lit("")).alias("refresher"),
        F.regexp_extract(minse, r"(\d+)", 1).try_cast("int").alias("min_se"),
        F.coalesce("has_183_sdp", F.lit(False)).alias("has_183_sdp"), F.coalesce("has_180_bare", F.lit(False)).alias("has_180_bare"), "pem",
        F.when(F.col("fax").isNull(), F.lit(None)).when(F.col("fax_status").isNull(), "no final response")
        .when(F.col("fax_status") < 300, "accepted").otherwise("rejected").alias("fax"),
        F.col("offer.origin.addr").alias("sdp_o"), F.col("offer.connection").alias("sdp_c"), F.coalesce("offer_body", F.lit("")).alias("sdp_text"),
    )


def _joined(h: Column) -> Column:
    return F.array_join(h["values"], " | ")


def _names(side: Column) -> Column:
    return F.transform(side["hmap"], lambda h: h["name"])


def _stripped(a, b):
    gone = F.filter(a["hmap"], lambda h: ~F.array_contains(_names(b), h["name"]))
    return F.transform(gone, lambda h: item("header-stripped", "notice", "headers", F.concat(F.lit("header stripped: "), h["display"]), _joined(h), F.lit(None)))


def _added(a, b):
    new = F.filter(b["hmap"], lambda h: ~F.array_contains(_names(a), h["name"]))
    return F.transform(new, lambda h: item("header-added", "info", "headers", F.concat(F.lit("header added: "), h["display"]), F.lit(None), _joined(h)))


def _rewritten(a, b):
    def other(h):
        return F.try_element_at(F.filter(b["hmap"], lambda x: x["name"] == h["name"]), F.lit(1))

    changed = F.filter(
        a["hmap"],
        lambda h: ~h["name"].isin(VALUE_IGNORE) & F.coalesce(other(h)["values"] != h["values"], F.lit(False)),
    )
    return F.transform(changed, lambda h: item("header-rewritten", "notice", "headers", F.concat(F.lit("header rewritten: "), h["display"]), _joined(h), _joined(other(h))))


def _leaks(a, b):
    texts = F.concat(F.transform(a["headers"], lambda h: F.coalesce(h["value"], F.lit(""))), F.array(F.coalesce(a["request_uri"], F.lit("")), a["sdp_text"]))
    found = F.array_distinct(F.flatten(F.transform(texts, lambda t: ips_in(t, True))))

    def places(ip):
        names = F.array_distinct(F.transform(F.filter(b["headers"], lambda h: F.coalesce(h["value"], F.lit("")).contains(ip)), lambda h: h["name"]))
        o = F.coalesce(b["sdp_o"] == ip, F.lit(False))
        c = F.coalesce(b["sdp_c"] == ip, F.lit(False))
        return F.concat(names, F.array_compact(F.array(
            F.when(F.coalesce(b["request_uri"], F.lit("")).contains(ip), "Request-URI"),
            F.when(o, "SDP o="), F.when(c, "SDP c="), F.when(~o & ~c & b["sdp_text"].contains(ip), "SDP"),
        )))

    leaks = F.filter(F.transform(found, lambda ip: F.struct(ip.alias("ip"), places(ip).alias("at"))), lambda x: F.size(x["at"]) > 0)
    return F.transform(leaks, lambda x: item("private-ip-leak", "crit", "topology", F.concat(F.lit("private address survives: "), x["ip"]), x["ip"], F.array_join(x["at"], ", ")))


def _timer_label(x):
    return F.concat_ws(
        ", ",
        F.when(x["se"].isNotNull(), F.concat_ws(";refresher=", F.concat(F.lit("Session-Expires "), x["se"].cast("string")), x["refresher"])),
        F.when(x["min_se"].isNotNull(), F.concat(F.lit("Min-SE "), x["min_se"].cast("string"))),
    )


def _or(x, label):
    return F.coalesce(x.cast("string"), F.lit(label))


def _frag(a, b):
    def one(side, label, first):
        risk = (side["transport"] == "udp") & (side["size"] > 1300)
        size = F.concat(side["size"].cast("string"), F.lit(" bytes"))
        return F.when(risk, item("udp-frag-risk", "warn", "transport", label, size if first else F.lit(None), F.lit(None) if first else size))

    return F.array_compact(F.array(one(a, "first request of the ingress is too large for UDP", True), one(b, "first request of the egress is too large for UDP", False)))


def _any(a, b, *names):
    cond = F.lit(False)
    for n in names:
        cond = cond | a[n].isNotNull() | b[n].isNotNull()
    return cond


SIP_COMPARATORS: tuple[Comparator, ...] = (
    Comparator("header-stripped", _stripped),
    Comparator("header-added", _added),
    Comparator("header-rewritten", _rewritten),
    when_differs("from-rewritten", "warn", "headers", "calling user changed", lambda a, b: a["from_user"] != b["from_user"], lambda a, b: a["from_uri"], lambda a, b: b["from_uri"]),
    when_differs("to-rewritten", "warn", "headers", "called user changed", lambda a, b: a["to_user"] != b["to_user"], lambda a, b: a["to_uri"], lambda a, b: b["to_uri"]),
    when_differs(
        "codec-narrowed", "info", "sdp", "fewer codecs offered on the egress",
        lambda a, b: (F.size(a["codecs"]) > 0) & (F.size(b["codecs"]) > 0) & (F.size(F.array_except(b["codecs"], a["codecs"])) == 0) & (F.size(b["codecs"]) < F.size(a["codecs"])),
        lambda a, b: F.array_join(a["codecs"], ", "), lambda a, b: F.array_join(b["codecs"], ", "),
    ),
    when_differs("codec-transcoding", "warn", "sdp", "different codecs answered", lambda a, b: a["answered_codec"] != b["answered_codec"], lambda a, b: a["answered_codec"], lambda a, b: b["answered_codec"]),
    when_differs("ptime-mismatch", "notice", "sdp", "packet times differ", lambda a, b: ~a["ptime"].eqNullSafe(b["ptime"]), lambda a, b: _or(a["ptime"], "not specified"), lambda a, b: _or(b["ptime"], "not specified")),
    when_differs("dtmf-pt-mismatch", "warn", "dtmf", "event payload types differ", lambda a, b: a["dtmf"] != b["dtmf"], lambda a, b: a["dtmf"], lambda a, b: b["dtmf"]),
    when_differs("dtmf-missing-one-leg", "warn", "dtmf", "events offered on one leg only", lambda a, b: a["dtmf"].isNull() != b["dtmf"].isNull(), lambda a, b: _or(a["dtmf"], "not offered"), lambda a, b: _or(b["dtmf"], "not offered")),
    when_differs(
        "100rel-asymmetry", lambda a, b: F.when((a["rel100"] == "required") & (b["rel100"] == "absent"), "warn").otherwise("notice"), "reliability",
        "reliable provisional responses differ", lambda a, b: a["rel100"] != b["rel100"], lambda a, b: a["rel100"], lambda a, b: b["rel100"],
    ),
    when_differs(
        "session-timer-changed", "info", "session-timers", "session timer changed",
        lambda a, b: _any(a, b, "se", "min_se") & ~(a["se"].eqNullSafe(b["se"]) & a["refresher"].eqNullSafe(b["refresher"]) & a["min_se"].eqNullSafe(b["min_se"])),
        lambda a, b: _timer_label(a), lambda a, b: _timer_label(b),
    ),
    when_differs(
        "session-timer-conflict", "warn", "session-timers", "smallest interval of one leg exceeds the interval of the other",
        lambda a, b: F.coalesce(a["min_se"] > b["se"], F.lit(False)) | F.coalesce(b["min_se"] > a["se"], F.lit(False)),
        lambda a, b: _timer_label(a), lambda a, b: _timer_label(b),
    ),
    when_differs(
        "early-media-183", "notice", "early-media", "early media on one leg, local ringing on the other",
        lambda a, b: (a["has_183_sdp"] & b["has_180_bare"] & ~b["has_183_sdp"]) | (b["has_183_sdp"] & a["has_180_bare"] & ~a["has_183_sdp"]),
        lambda a, b: F.when(a["has_183_sdp"], "183 with SDP").otherwise("180 without SDP"), lambda a, b: F.when(b["has_183_sdp"], "183 with SDP").otherwise("180 without SDP"),
    ),
    when_differs("early-media-pem", "info", "early-media", "early media header present", lambda a, b: _any(a, b, "pem"), lambda a, b: _or(a["pem"], "absent"), lambda a, b: _or(b["pem"], "absent")),
    Comparator("udp-frag-risk", _frag),
    Comparator("private-ip-leak", _leaks),
    when_differs(
        "t38-asymmetry", "warn", "t38", "fax switch differs between legs",
        lambda a, b: (a["fax"].isNull() != b["fax"].isNull()) | F.coalesce((a["fax"] == "accepted") != (b["fax"] == "accepted"), F.lit(False)),
        lambda a, b: _or(a["fax"], "no fax switch"), lambda a, b: _or(b["fax"], "no fax switch"),
    ),
)


def diff_calls(pairs: DataFrame, profiles: DataFrame, comparators: Sequence[Comparator] = SIP_COMPARATORS) -> DataFrame:
    """Change items of accepted leg pairs (capture_id, ingress, egress, ...)."""
    items = diff_pairs(pairs, profiles, profiles, comparators, ["capture_id"], "ingress_leg", "egress_leg")
    return items.withColumnRenamed("ingress", "ingress_value").withColumnRenamed("egress", "egress_value")
