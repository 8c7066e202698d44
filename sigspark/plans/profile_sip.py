"""Telephony profile: what the general operators are told about call signalling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.net import address_class
from sigspark.functions.sip import (
    digits,
    has_header,
    header,
    headers,
    option_tags,
    same_party,
    uri_host,
    via_host,
)
from sigspark.operators.classify import SUBJECTS, Indicator, Rule, Test, with_subjects
from sigspark.operators.labels import LabelRule, label_texts, rule_table
from sigspark.operators.linkage import Block, Linkage, Proximity, Signal
from sigspark.operators.matching import match_containment
from sigspark.operators.ordered import epoch_us, peak_concurrency
from sigspark.operators.rollups import common_prefix, upper_median

CAPTURE = ["capture_id"]

# ---- linkage of call legs ------------------------------------------------------------------------


# Words by which equipment names itself in User-Agent and Server, with the name that fixes are filed under.
VENDOR_RULES = [
    LabelRule("oracle-acme", "acme", r"acme\s*packet"), LabelRule("oracle-acme", "net-net"), LabelRule("oracle-acme", "oracle"),
    LabelRule("oracle-acme", "sbc", r"sd\s*sbc"), LabelRule("oracle-acme", "os-e"),
    LabelRule("audiocodes", "audiocodes"), LabelRule("audiocodes", "mediant"), LabelRule("audiocodes", "mp-1", r"mp-1\d{2}"), LabelRule("audiocodes", "mp-5", r"mp-5\d{2}"),
    LabelRule("ribbon", "ribbon"), LabelRule("ribbon", "sonus"), LabelRule("ribbon", "sbc", r"sbc\s*[57]\d{3}"), LabelRule("ribbon", "nbs"), LabelRule("ribbon", "sbc", r"sbc\s*swe"),
    LabelRule("cisco-cube", "cisco", r"cisco-?sipgateway|cisco-?cube|cisco\s*ios"),
    LabelRule("freeswitch", "freeswitch"),
    LabelRule("asterisk", "asterisk"), LabelRule("asterisk", "freepbx"),
]


def vendors(messages: DataFrame) -> DataFrame:
    """(capture_id, vendor): equipment that the messages of a capture name themselves."""
    said = messages.select("capture_id", F.explode(F.concat(headers(F.col("headers"), "user-agent"), headers(F.col("headers"), "server"))).alias("agent"))
    return label_texts(said, rule_table(messages.sparkSession, VENDOR_RULES), ["capture_id"], "agent").withColumnRenamed("label", "vendor")


def party_keys(user: Column) -> Column:
    """Keys of which two user parts naming one party share at least one."""
    low = F.lower(F.trim(user))
    d = digits(user)
    alt = (
        F.when((F.length(d) > 2) & d.startswith("00"), F.substring(d, 3, 100))
        .when((F.length(d) > 1) & d.startswith("0"), F.substring(d, 2, 100))
        .otherwise(d)
    )
    number = F.when(low.rlike(r"^[+0-9()\-. #*]+$") & (d != ""), F.array(d, alt)).otherwise(F.array().cast("array<string>"))
    forms = F.transform(number, lambda v: F.when(F.length(v) >= 6, F.concat(F.lit("s:"), F.right(v, F.lit(6)))).otherwise(F.concat(F.lit("n:"), v)))
    return F.when(low.isNotNull() & (low != ""), F.array_distinct(F.concat(F.array(F.concat(F.lit("e:"), low)), forms)))


def leg_order(leg_id: str = "leg_id") -> Column:
    return F.concat(F.substring(leg_id, 1, 1), F.lpad(F.substring(leg_id, 2, 20), 12, "0"))


def leg_nodes(sip_legs: DataFrame, leg_messages: DataFrame, h323_legs: DataFrame | None = None) -> DataFrame:
    """Call legs as linkage records, with the attributes of their first request."""
    hs = F.col("headers")
    icid = header(hs, "p-charging-vector")
    quoted = F.regexp_extract(icid, r'(?i)icid-value\s*=\s*"([^"]*)"', 1)
    plain = F.regexp_extract(icid, r'(?i)icid-value\s*=\s*([^;,\s"]+)', 1)
    xs = F.transform(
        F.filter(hs, lambda h: F.lower(h["name"]).startswith("x-") & (F.trim(F.coalesce(h["value"], F.lit(""))) != "")),
        lambda h: F.concat(F.lower(h["name"]), F.lit("="), F.trim(h["value"])),
    )
    inv = leg_messages.select(
        "capture_id", "leg_id", F.col("msg_id").alias("invite_id"),
        F.nullif(F.trim(F.when(quoted != "", quoted).otherwise(plain)), F.lit("")).alias("icid"), F.array_distinct(xs).alias("xs"),
        F.when(F.col("sdp.origin.sess_id").isNotNull(), F.concat_ws("/", F.col("sdp.origin.sess_id"), F.col("sdp.origin.sess_version"))).alias("sess"),
        via_host(F.try_element_at(F.col("vias"), F.lit(1))).alias("via"), uri_host(F.col("contact")).alias("contact"), F.size("vias").alias("n_vias"),
    )
    calls = sip_legs.where((F.col("kind") == "call") & F.col("invite_id").isNotNull())
    rest = sip_legs.where((F.col("kind") == "call") & F.col("invite_id").isNull())
    nodes = calls.join(inv, ["capture_id", "leg_id", "invite_id"]).unionByName(rest, allowMissingColumns=True)
    if h323_legs is not None:
        nodes = nodes.unionByName(h323_legs.select("capture_id", "leg_id", "start_ts"), allowMissingColumns=True)
    nodes = nodes.withColumn("to_keys", party_keys(F.col("to_user"))).withColumn("from_keys", party_keys(F.col("from_user")))

    def crossed(a: str, b: str) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(F.coalesce(b, F.array().cast("array<string>")), lambda k: F.concat_ws("|", x, k))))

    return nodes.select(
        "capture_id", F.col("leg_id").alias("node_id"), "start_ts", leg_order().alias("ord"), "icid", "xs", "sess", "to_user", "from_user",
        "to_keys", "from_keys", crossed("xs", "to_keys").alias("xs_to"), crossed("xs", "from_keys").alias("xs_from"), "via", "contact", "n_vias", "src",
    )


def _users(a: Column, b: Column) -> Column:
    to, frm = same_party(a["to_user"], b["to_user"]), same_party(a["from_user"], b["from_user"])
    return F.when(to & frm, 1.0).when(to | frm, 0.5).otherwise(0.0)


def _rewritten_side(b: Column) -> Column:
    return (b["contact"] == b["src"]) | ((b["via"] == b["src"]) & (F.coalesce(b["n_vias"], F.lit(1)) == 1))


def _rewritten(a: Column, b: Column) -> Column:
    contact = (a["contact"] != b["contact"]) & (b["contact"] == b["src"])
    via = (a["via"] != b["via"]) & (b["via"] == b["src"]) & (b["n_vias"] == 1)
    return F.coalesce(contact, F.lit(False)) | F.coalesce(via, F.lit(False))


# 500 needs an id or vendor header plus anything else, or the session origin plus time and more:
# each block below is one such combination, so no pair that can reach 500 is missed.
SIP_LINK = Linkage(
    scope=("capture_id",),
    attributes=("icid", "xs", "sess", "to_user", "from_user", "to_keys", "from_keys", "xs_to", "xs_from", "via", "contact", "n_vias", "src"),
    signals=(
        Signal("pcv-icid", 450, lambda a, b: a["icid"] == b["icid"]),
        Signal("x-header", 450, lambda a, b: F.arrays_overlap(a["xs"], b["xs"])),
        Signal("sdp-origin", 300, lambda a, b: a["sess"] == b["sess"]),
        Signal("user-parts", 100, _users),
        Signal("via-rewrite", 50, _rewritten),
    ),
    blocks=(
        Block(("icid",), near=True), Block(("icid", "to_keys")), Block(("icid", "from_keys")), Block(("icid", "xs")), Block(("icid", "sess")),
        Block(("icid",), right_if=_rewritten_side), Block(("xs",), near=True), Block(("xs_to",)), Block(("xs_from",)), Block(("sess", "xs")),
        Block(("xs",), right_if=_rewritten_side), Block(("sess",), near=True),
    ),
    proximity=Proximity(150, 250_000),
)


def cross_protocol_pairs(sip_legs: DataFrame, leg_messages: DataFrame, h323_legs: DataFrame, threshold: int = 500) -> DataFrame:
    """SIP and Q.931 legs of one call: numbers with a common suffix of six digits 450, at most half a
    second apart 300, the call identifier in a SIP header 250. A pair needs two of the three, so pairs
    come from (number, time bucket) and from the identifier."""
    s = sip_legs.where(F.col("kind") == "call").select(
        "capture_id", F.col("leg_id").alias("s_id"), epoch_us(F.col("start_ts")).alias("s_t"), "invite_id",
        digits(F.col("to_user")).alias("s_to"), digits(F.col("from_user")).alias("s_from"),
    )
    h = h323_legs.select(
        "capture_id", F.col("leg_id").alias("h_id"), epoch_us(F.col("start_ts")).alias("h_t"),
        digits(F.coalesce("to_user", "to_uri")).alias("h_to"), digits(F.coalesce("from_user", "from_uri")).alias("h_from"), "guid",
    )

    def tails(side: str) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.length(f"{side}_{w}") >= 6, F.concat(F.lit(w + ":"), F.right(F.col(f"{side}_{w}"), F.lit(6)))) for w in ("to", "from")
        ]))

    half = 500_000
    sb = F.floor(F.col("s_t") / half)
    left = s.select("capture_id", "s_id", F.explode(tails("s")).alias("k"), sb.alias("_b")).withColumn("b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    right = h.select("capture_id", "h_id", F.explode(tails("h")).alias("k"), F.floor(F.col("h_t") / half).alias("b"))
    near_number = left.join(right, ["capture_id", "k", "b"]).select("capture_id", "s_id", "h_id")
    needle = F.regexp_replace(F.lower("guid"), "[^0-9a-f]", "")
    guids = h.where(F.length(needle) >= 16).select("capture_id", "h_id", needle.alias("needle"))
    text = F.lower(F.array_join(F.transform("headers", lambda x: F.concat_ws(": ", x["name"], x["value"])), "\n"))
    runs = F.array_union(F.regexp_extract_all(text, F.lit("[0-9a-f]{16,}"), F.lit(0)), F.regexp_extract_all(F.regexp_replace(text, "-", ""), F.lit("[0-9a-f]{16,}"), F.lit(0)))
    invites = leg_messages.select("capture_id", F.col("msg_id").alias("invite_id"), F.explode(runs).alias("run"))
    words = s.join(invites, ["capture_id", "invite_id"]).select("capture_id", "s_id", "run")
    hit = match_containment(guids, words, "needle", "run", 16)
    by_guid = hit.join(guids, ["capture_id", "needle"]).join(words, ["capture_id", "run"]).select("capture_id", "s_id", "h_id").distinct()
    pairs = near_number.unionByName(by_guid).distinct().join(by_guid.withColumn("_g", F.lit(1)), ["capture_id", "s_id", "h_id"], "left")
    pairs = pairs.join(s, ["capture_id", "s_id"]).join(h, ["capture_id", "h_id"])

    def tail_equal(w):
        a, b = F.col(f"s_{w}"), F.col(f"h_{w}")
        return (F.length(a) >= 6) & (F.length(b) >= 6) & (F.right(a, F.lit(6)) == F.right(b, F.lit(6)))

    score = (
        F.when(tail_equal("to") | tail_equal("from"), 450).otherwise(0)
        + F.when(F.abs(F.col("s_t") - F.col("h_t")) <= half, 300).otherwise(0)
        + F.when(F.col("_g") == 1, 250).otherwise(0)
    )
    out = pairs.withColumn("score", F.least(F.lit(1000), score).cast("bigint")).where(F.col("score") >= threshold)
    first_sip = F.col("s_t") <= F.col("h_t")
    return out.select(
        "capture_id", F.when(first_sip, F.col("s_id")).otherwise(F.col("h_id")).alias("ingress"),
        F.when(first_sip, F.col("h_id")).otherwise(F.col("s_id")).alias("egress"),
        F.least("s_t", "h_t").alias("t"), "score",
    ).withColumn("ord", leg_order("ingress"))


# ---- facts -----------------------------------------------------------------------------------------

# What user agents of each kind call themselves.
PBX_AGENTS = (
    r"avaya|cisco|cucm|cube|ios-voice|mitel|3cx|asterisk|freepbx|freeswitch|kamailio|opensips|innovaphone|unify|openscape|"
    r"panasonic|yeastar|grandstream|alcatel|ericsson-lg|epygi|patton|sangoma|snom|polycom|audiocodes|oracle|acmepacket|ribbon|"
    r"sonus|metaswitch|broadworks|teams|skype for business|lync"
)
TEST_AGENTS = r"sipp|pjsua|pjsip-perf|sipsak|sipvicious|friendly-scanner|sipcli|sip-tester|sipexer|voiperf|sipptest"
FAX_AGENTS = r"fax|brooktrout|dialogic|xmedius|hylafax|t38modem|ferrari"
BROWSER_AGENTS = r"sip\.js|jssip|sipml5|webrtc|jitsi|linphone-web|chrome|firefox|safari"
FIXED_ACCESS = r"adsl|vdsl|xdsl|ftth|fttb|gpon|docsis|ethernet|ieee-802\.11|wlan"
MOBILE_ACCESS = r"3gpp-nr|3gpp-e-utran|3gpp-utran[^;]*|5gs|3gpp-5g"
NR_ACCESS = r"3gpp-nr|5gs|3gpp-5g|nr-fdd|nr-tdd"

# Header names that mark an operator core.
MARKER_HEADERS = [
    "path", "service-route", "p-associated-uri", "p-early-media", "p-access-network-info",
    "p-visited-network-id", "p-charging-function-addresses", "feature-caps",
]


def any_of(cond: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(cond, F.lit(False)).cast("int")) == 1, F.lit(False))


def _marker_conditions() -> dict[str, Column]:
    hs = F.col("headers")
    pani = F.lower(F.coalesce(header(hs, "p-access-network-info"), F.lit("")))
    contact = F.lower(F.coalesce("contact", F.lit("")))
    register = F.col("is_request") & (F.col("method") == "REGISTER")
    out = {name.replace("-", "_"): has_header(hs, name) for name in MARKER_HEADERS}
    out["p_charging_vector"] = F.lower(header(hs, "p-charging-vector")).contains("icid-value")
    out["route_orig"] = F.exists(F.transform(F.coalesce("routes", F.array().cast("array<string>")), F.lower), lambda r: r.rlike(r"sip:orig@|[;?<]orig\b"))
    out["third_party_register"] = register & ((F.col("_from_user") != F.col("_to_user")) | F.col("body_type").rlike("multipart|message/sip"))
    out["preconditions"] = F.col("_sdp").rlike(r"a=(?:curr|des|conf):")
    out["access_5g"] = pani.rlike(NR_ACCESS)
    out["gruu"] = contact.contains(";gr=") | (contact.contains("+sip.instance") & contact.contains("gr"))
    return out


def message_facts(messages: DataFrame) -> DataFrame:
    """One row per capture of everything the tests and indicators ask of messages: one aggregate."""
    from sigspark.functions.sip import uri_user

    hs = F.col("headers")
    base = messages.withColumn("_sdp", F.when(F.col("sdp").isNotNull(), F.lower(F.coalesce("body", F.lit("")))))
    base = base.withColumn("_from_user", uri_user(F.col("from_uri"))).withColumn("_to_user", uri_user(F.col("to_uri")))
    base = base.withColumn("_agent", F.lower(F.concat_ws(" ", F.array_join(headers(hs, "user-agent"), " "), F.array_join(headers(hs, "server"), " "))))
    base = base.withColumn("_require", option_tags(headers(hs, "require"))).withColumn("_supported", option_tags(headers(hs, "supported")))
    base = base.withColumn("_codecs", F.transform(F.flatten(F.transform(F.col("sdp.media"), lambda m: m["payloads"])), lambda p: F.lower(p["codec"])))
    rq, st, me, cm = F.col("is_request"), F.col("status"), F.col("method"), F.col("cseq.method")
    sdp, pani = F.col("_sdp"), F.lower(F.coalesce(header(hs, "p-access-network-info"), F.lit("")))
    hops = F.regexp_extract(header(hs, "max-forwards"), r"(\d+)", 1).try_cast("int")
    se = F.regexp_extract(header(hs, "session-expires"), r"(\d+)", 1).try_cast("int")
    minse = F.regexp_extract(header(hs, "min-se"), r"(\d+)", 1).try_cast("int")
    allow = F.upper(F.concat_ws(",", headers(hs, "allow")))
    codec = lambda *names: any_of(F.arrays_overlap("_codecs", F.array(*[F.lit(n) for n in names])))
    known = F.filter("_codecs", lambda c: c.isNotNull())
    flags = {f"mk_{k}": any_of(v) for k, v in _marker_conditions().items()}
    out = base.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(rq).alias("n_requests"), F.count_if(~rq).alias("n_responses"),
        *[F.count_if(rq & (me == m)).alias(f"n_{m.lower()}") for m in ("INVITE", "REGISTER", "OPTIONS", "REFER", "SUBSCRIBE", "PRACK", "UPDATE", "NOTIFY")],
        F.countDistinct(F.when(rq & (me == "REGISTER"), F.coalesce("to_uri", "from_uri"))).alias("n_aors"),
        F.count_if(has_header(hs, "diversion") | has_header(hs, "history-info")).alias("n_diversions"),
        any_of(has_header(hs, "history-info")).alias("has_history"), any_of(F.array_contains("_supported", "histinfo")).alias("supports_history"),
        any_of(rq & has_header(hs, "history-info") & (F.col("size") > 1300) & (F.lower("transport") == "udp")).alias("history_too_large"),
        F.max(F.size("vias")).alias("max_vias"), F.min(hops).alias("min_hops"),
        *[any_of(F.col("_agent").rlike(p)).alias(n) for n, p in (("pbx_agent", PBX_AGENTS), ("test_agent", TEST_AGENTS), ("fax_agent", FAX_AGENTS), ("browser_agent", BROWSER_AGENTS), ("sample_agent", r"(sipp|test|user|service)\d*"))],
        any_of(F.col("isup").isNotNull() | F.lower(header(hs, "content-type")).contains("application/isup")).alias("has_isup"),
        any_of(F.col("isup").isNotNull()).alias("isup_decoded"), any_of(F.col("isup.cause_code").isin(*NETWORK_FAULTS)).alias("isup_fault"),
        any_of(F.lower(header(hs, "content-type")).rlike("application/isup|multipart")).alias("isup_advertised"),
        F.count_if(sdp.isNotNull()).alias("n_sdp"), any_of(sdp.rlike("m=image|udptl|t38")).alias("sdp_t38"),
        any_of(sdp.rlike("t38faxversion|t38faxmaxdatagram|t38faxratemanagement|a=fax")).alias("fax_attrs"), any_of(sdp.contains("a=fingerprint:")).alias("has_fingerprint"),
        any_of(sdp.rlike("a=ice-ufrag|a=candidate")).alias("ice_attrs"), any_of(sdp.rlike(r"(?m)^m=audio [1-9]")).alias("sdp_audio"),
        any_of(sdp.rlike("savp|a=crypto")).alias("sdp_secure"), any_of(sdp.rlike(r"(?m)^m=image 0 ")).alias("image_port_0"),
        codec("amr", "amr-wb", "evs", "evs-wb").alias("mobile_codec"), codec("opus").alias("opus"), any_of(F.size(known) > 0).alias("any_codec"),
        any_of(F.exists(known, lambda c: ~c.isin("pcmu", "pcma", "telephone-event"))).alias("other_codec"),
        codec("telephone-event").alias("has_dtmf"), any_of(pani.rlike(FIXED_ACCESS)).alias("fixed_access"), any_of(pani.rlike(MOBILE_ACCESS)).alias("mobile_access"),
        any_of(sdp.contains("a=des:")).alias("has_desired"), any_of(sdp.contains("a=conf:")).alias("has_confirmed"),
        any_of(F.array_contains("_require", "100rel")).alias("rel_required"), any_of(F.array_contains("_supported", "100rel")).alias("rel_supported"),
        any_of(~rq & st.between(101, 199) & has_header(hs, "rseq")).alias("has_rseq"), any_of(~rq & (cm == "INVITE") & st.between(101, 199)).alias("has_18x"),
        *[any_of(~rq & (st == s)).alias(f"s{s}") for s in (415, 420, 422, 488, 580, 606)],
        any_of(~rq & (cm == "UPDATE") & st.isin(405, 501, 488, 420)).alias("update_refused"), any_of(allow.contains("UPDATE")).alias("update_allowed"), any_of(allow.contains("REFER")).alias("refer_allowed"),
        any_of(se.isNotNull()).alias("has_timer"), any_of(F.array_contains("_supported", "timer")).alias("timer_supported"), any_of(minse > se).alias("timer_self_conflict"),
        any_of(F.array_contains("_require", "precondition")).alias("precondition_required"), any_of(F.array_contains("_supported", "precondition")).alias("precondition_supported"),
        any_of(~rq & (cm == "REGISTER") & st.between(200, 299)).alias("register_ok"), any_of(~rq & (cm == "REGISTER")).alias("register_answered"),
        any_of(~rq & (cm == "REGISTER") & st.between(200, 299) & ~has_header(hs, "service-route")).alias("ok_without_service_route"),
        any_of(~rq & (cm == "REFER") & (st >= 300)).alias("refer_refused"),
        any_of(rq & (me == "NOTIFY") & F.col("body_type").contains("sipfrag") & (F.regexp_extract("body", r"^SIP/2\.0 (\d{3})", 1).try_cast("int") >= 300)).alias("sipfrag_failed"),
        any_of(~rq & (cm == "INVITE") & (st == 183) & sdp.isNotNull()).alias("early_183"),
        any_of(F.lower("transport") == "tcp").alias("has_tcp"), any_of(F.lower("transport") == "udp").alias("has_udp"), any_of((F.lower("transport") == "tls") | (F.col("sport") == 5061) | (F.col("dport") == 5061)).alias("has_tls"),
        any_of(~((F.lower("transport") == "tls") | (F.col("sport") == 5061) | (F.col("dport") == 5061))).alias("has_clear"),
        any_of(F.col("src").contains(":")).alias("v6_signalling"), any_of(~F.col("src").contains(":")).alias("v4_signalling"), any_of(sdp.contains("in ip4")).alias("v4_media"), any_of(sdp.contains("in ip6")).alias("v6_media"),
        F.countDistinct(F.nullif(digits(F.col("_from_user")), F.lit(""))).alias("n_user_parts"),
        *[v.alias(k) for k, v in flags.items()],
    )
    total = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return out.withColumn("n_markers", total)


# Fixed values (Q.850): causes that speak of a fault of the network.
NETWORK_FAULTS = [34, 38, 41, 42, 43, 44, 47, 63, 102, 111, 127]


def leg_facts(legs: DataFrame) -> DataFrame:
    """Setup times, abandoned share and host pairs of the call legs."""
    calls = legs.where(F.col("kind") == "call")
    setup = calls.where(F.col("answer_ts") >= F.col("start_ts")).withColumn("setup_us", epoch_us(F.col("answer_ts")) - epoch_us(F.col("start_ts")))
    median = upper_median(setup, CAPTURE, "setup_us", ["leg_id"]).select("capture_id", F.floor(F.col("upper_median") / 1000.0 + 0.5).alias("median_setup_ms"))
    a, b = F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit(""))
    counts = calls.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_call_legs"), F.count_if(F.col("state").isin("canceled", "no-answer")).alias("n_abandoned"),
        F.countDistinct(F.when((a != "") | (b != ""), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))).alias("n_peer_pairs"),
        any_of(F.col("protocol") == "h323").alias("has_h323"), any_of((F.col("protocol") == "h323") & ((F.col("state") == "failed") | F.col("fail_code").isin(*NETWORK_FAULTS))).alias("h323_fault"),
        any_of((F.col("protocol") == "sip") & (F.col("state") == "failed")).alias("sip_failed"), any_of(F.col("answered")).alias("any_answered"),
    )
    return counts.join(median, CAPTURE, "left").withColumn("abandoned_pct", F.floor(F.col("n_abandoned") * 100.0 / F.col("n_call_legs") + 0.5))


def call_facts(calls: DataFrame, call_legs: DataFrame, legs: DataFrame) -> DataFrame:
    """Concurrency and called numbers, one number per call (that of its first leg)."""
    lg = legs.select("capture_id", "leg_id", "start_ts", "end_ts", "to_user", "to_uri", "protocol", "state")
    cl = call_legs.join(lg, ["capture_id", "leg_id"])
    spans = cl.groupBy("capture_id", "call_no").agg(
        F.min("start_ts").alias("s"), F.max("end_ts").alias("e"), F.min_by(digits(F.coalesce("to_user", "to_uri")), F.struct("start_ts", "leg_id")).alias("number"),
        F.countDistinct("protocol").alias("k"), F.countDistinct("state").alias("states"), F.count(F.lit(1)).alias("n_legs"),
    )
    peak = peak_concurrency(spans, "s", "e", CAPTURE).select("capture_id", F.col("peak").alias("peak_concurrent"))
    numbers = spans.where(F.col("number") != "")
    per = numbers.groupBy("capture_id", "number").agg(F.count(F.lit(1)).alias("n"))
    share = per.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_called"), (F.max("n") / F.sum("n")).alias("top_share"),
        F.countDistinct(F.when(F.length("number") >= 4, F.substring("number", 1, 4))).alias("n_prefixes"),
        F.count_if(F.col("number").rlike(r"^[1-9]\d{7,14}$")).alias("n_e164"), F.count_if(F.length("number") <= 5).alias("n_short"),
    )
    prefix = common_prefix(per, CAPTURE, F.col("number")).select("capture_id", F.length("prefix").alias("prefix_len"))
    counts = calls.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("state") == "ambiguous").alias("n_ambiguous"), F.count_if(F.col("state") == "paired").alias("n_paired")
    )
    mixed = spans.groupBy("capture_id").agg(any_of(F.col("k") == 2).alias("iwf_paired"), any_of((F.col("k") == 2) & (F.col("states") > 1)).alias("iwf_differs"), F.max("n_legs").alias("max_legs"))
    out = counts
    for df in (peak, share, prefix, mixed):
        out = out.join(df, CAPTURE, "left")
    return out


def address_facts(messages: DataFrame) -> DataFrame:
    """Distinct signalling addresses by class."""
    ends = messages.select("capture_id", F.explode(F.array("src", "dst")).alias("ip")).where(F.col("ip") != "").distinct()
    c = address_class(F.col("ip"))
    return ends.withColumn("c", c).groupBy("capture_id").agg(
        F.count_if(F.col("c") == "documentation").alias("n_doc"), F.count_if(F.col("c").isin("private", "cgnat")).alias("n_private"), F.count_if(F.col("c").isin("public", "v6")).alias("n_public")
    )


def stream_facts(streams: DataFrame | None, rtcp: DataFrame | None, spark) -> DataFrame:
    """Media of a capture: streams, loss, gaps, direction, control reports."""
    if streams is None:
        return spark.createDataFrame([], "capture_id string, n_streams bigint, one_way boolean, lossy boolean, gapped boolean, t38_stream boolean, srtp_stream boolean, clear_stream boolean, first_media_ts timestamp, has_rtcp boolean, rtcp_loss boolean")
    out = streams.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_streams"), any_of(F.col("one_way")).alias("one_way"), any_of(F.col("loss_pct") >= 5).alias("lossy"), any_of(F.col("max_gap_ms") >= 1000).alias("gapped"),
        any_of(F.col("kind") == "t38-udptl").alias("t38_stream"), any_of(F.col("kind") == "srtp").alias("srtp_stream"), any_of(F.col("kind") == "rtp").alias("clear_stream"), F.min("first_ts").alias("first_media_ts"),
    )
    if rtcp is None:
        return out.withColumn("has_rtcp", F.lit(False)).withColumn("rtcp_loss", F.lit(False))
    r = rtcp.groupBy("capture_id").agg(F.lit(True).alias("has_rtcp"), any_of(F.col("fraction_lost") / 256.0 * 100 >= 5).alias("rtcp_loss"))
    return out.join(r, CAPTURE, "full")


def aux_facts(spark, dns=None, diameter=None, checks=None, handshakes=None) -> DataFrame:
    """Auxiliary protocols of a capture. Arguments are exchange tables and rollups, or None."""
    parts = []
    if dns is not None:
        rc = F.col("response_rcode")
        parts.append(dns.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_dns"), any_of(F.col("timed_out")).alias("dns_timeout"), any_of(F.col("slow")).alias("dns_slow"), any_of(rc != "NOERROR").alias("dns_error")))
    if diameter is not None:
        code = F.coalesce("response_result_code", "response_experimental_code")
        linked = F.col("linked") if "linked" in diameter.columns else F.lit(False)
        parts.append(diameter.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_diameter"), any_of(code >= 3000).alias("diameter_failed"), any_of(F.col("timed_out")).alias("diameter_unanswered"), any_of(linked).alias("diameter_linked")))
    if checks is not None:
        parts.append(checks.groupBy("capture_id").agg(F.sum("n_requests").alias("n_checks"), any_of(F.col("state") == "succeeded").alias("check_ok")))
    if handshakes is not None:
        parts.append(handshakes.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_dtls"), any_of(~F.col("complete")).alias("dtls_stalled")))
    out = spark.createDataFrame([], "capture_id string")
    for p in parts:
        out = out.join(p, CAPTURE, "full")
    for name, kind in AUX_FACTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


AUX_FACTS = {
    "n_dns": "bigint", "dns_timeout": "boolean", "dns_slow": "boolean", "dns_error": "boolean", "n_diameter": "bigint",
    "diameter_failed": "boolean", "diameter_unanswered": "boolean", "diameter_linked": "boolean", "n_checks": "bigint",
    "check_ok": "boolean", "n_dtls": "bigint", "dtls_stalled": "boolean",
}
DIFF_TAGS = [
    "t38-asymmetry", "dtmf-pt-mismatch", "dtmf-missing-one-leg", "100rel-asymmetry", "session-timer-conflict", "private-ip-leak",
    "codec-narrowed", "codec-transcoding", "early-media-183", "header-rewritten", "header-stripped",
]


def diff_facts(items: DataFrame | None, spark) -> DataFrame:
    names = ["d_" + t.replace("-", "_") for t in DIFF_TAGS]
    if items is None:
        return spark.createDataFrame([], "capture_id string, " + ", ".join(f"{n} boolean" for n in names) + ", d_any boolean, d_100rel_warn boolean, d_history boolean")
    return items.groupBy("capture_id").agg(
        *[any_of(F.col("tag") == t).alias(n) for t, n in zip(DIFF_TAGS, names, strict=True)], F.lit(True).alias("d_any"),
        any_of((F.col("tag") == "100rel-asymmetry") & (F.col("severity") == "warn")).alias("d_100rel_warn"),
        any_of(F.col("tag").isin("header-stripped", "header-rewritten") & F.lower("label").contains("history-info")).alias("d_history"),
    )


def repeat_facts(collapses: DataFrame, leg_messages: DataFrame) -> DataFrame:
    nonce = F.regexp_extract(F.coalesce(header(F.col("headers"), "www-authenticate"), header(F.col("headers"), "proxy-authenticate"), F.lit("")), r'(?i)nonce="?([^",]+)', 1)
    loops = leg_messages.where(~F.col("is_request") & F.col("status").isin(401, 407)).withColumn("nonce", F.nullif(nonce, F.lit("")))
    looped = loops.where(F.col("nonce").isNotNull()).groupBy("capture_id", "nonce").agg(F.count(F.lit(1)).alias("k")).groupBy("capture_id").agg(any_of(F.col("k") > 1).alias("nonce_repeated"))
    c = collapses.groupBy("capture_id").agg(any_of(F.lower("transport") == "tcp").alias("tcp_repeats"), any_of(F.col("code") == "dns-blocking").alias("dns_blocking"))
    return c.join(looped, CAPTURE, "full")


# ---- scenario tests ------------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def scenario_tests() -> list[Test]:
    calls = _n("n_calls")
    has_t38 = _c("sdp_t38") | F.coalesce("t38_stream", F.lit(False))
    return [
        Test("call-centre", "concurrent-volume", 250, (_n("peak_concurrent") >= 5) | (calls >= 20)),
        Test("call-centre", "short-setups", 150, (calls >= 5) & (_c("median_setup_ms") < 4000)),
        Test("call-centre", "abandoned-calls", 150, (calls >= 5) & (_n("abandoned_pct") >= 25)),
        Test("call-centre", "one-number", 150, (calls >= 4) & (_n("top_share") >= 0.3)),
        Test("call-centre", "queue-hops", 150, _n("n_diversions") >= 2),
        Test("call-centre", "transfers", 150, _n("n_refer") >= 2),
        Test("enterprise-trunk", "single-trunk-pair", 250, _n("n_peer_pairs").between(1, 3) & (calls <= 50)),
        Test("enterprise-trunk", "pbx-agent", 250, _c("pbx_agent")),
        Test("enterprise-trunk", "number-block", 150, (_n("n_e164") >= 1) & (_n("prefix_len") >= 5)),
        Test("enterprise-trunk", "no-registration", 100, (_n("n_register") == 0) & (calls >= 1)),
        Test("enterprise-trunk", "keepalives", 150, _n("n_options") >= 2),
        Test("enterprise-trunk", "no-markers", 100, _n("n_markers") == 0),
        Test("residential-ims", "route-set", 300, _c("mk_path") | _c("mk_service_route")),
        Test("residential-ims", "single-subscriber", 200, _n("n_aors") == 1),
        Test("residential-ims", "fixed-access", 200, _c("fixed_access")),
        Test("residential-ims", "associated-identities", 150, _c("mk_p_associated_uri")),
        Test("residential-ims", "single-line", 150, (calls <= 2) & (_n("peak_concurrent") <= 1)),
        Test("volte-5g", "core-markers", 200, _n("n_markers") >= 3),
        Test("volte-5g", "preconditions", 200, _c("mk_preconditions")),
        Test("volte-5g", "mobile-access", 250, _c("mobile_access")),
        Test("volte-5g", "mobile-codecs", 200, _c("mobile_codec")),
        Test("volte-5g", "policy-exchange", 150, _n("n_diameter") > 0),
        Test("carrier-interconnect", "isup-bodies", 300, _c("has_isup")),
        Test("carrier-interconnect", "no-registration", 150, (_n("n_register") == 0) & (calls >= 2)),
        Test("carrier-interconnect", "number-breadth", 200, (_n("n_called") >= 5) & (_n("n_prefixes") >= 3)),
        Test("carrier-interconnect", "transit", 200, (_n("max_vias") >= 3) | (_c("min_hops") <= 64)),
        Test("carrier-interconnect", "public-addresses", 150, (_n("n_public") >= 2) & (_n("n_private") == 0)),
        Test("webrtc-ott", "checks", 300, _n("n_checks") > 0),
        Test("webrtc-ott", "secure-handshake", 250, (_n("n_dtls") > 0) | _c("has_fingerprint")),
        Test("webrtc-ott", "opus", 200, _c("opus")),
        Test("webrtc-ott", "ice-attributes", 150, _c("ice_attrs")),
        Test("webrtc-ott", "browser-agent", 100, _c("browser_agent")),
        Test("fax-service", "fax-media", 450, has_t38),
        Test("fax-service", "fax-attributes", 250, _c("fax_attrs")),
        Test("fax-service", "pass-through", 150, _c("any_codec") & ~_c("other_codec") & (has_t38 | _c("fax_agent"))),
        Test("fax-service", "fax-agent", 150, _c("fax_agent")),
        Test("lab-test", "test-agent", 350, _c("test_agent")),
        Test("lab-test", "documentation-addresses", 300, (_n("n_doc") >= 1) & (_n("n_public") == 0)),
        Test("lab-test", "synthetic-numbers", 200, ((_n("n_called") >= 2) & (_n("n_short") == _n("n_called"))) | (_c("sample_agent") & (_n("n_user_parts") <= 2))),
        Test("lab-test", "private-only", 100, (_n("n_private") >= 1) & (_n("n_public") == 0) & (_n("n_doc") == 0)),
        Test("lab-test", "no-media", 100, F.coalesce("is_pcap", F.lit(True)) & (_n("n_sdp") >= 1) & (_n("n_streams") == 0)),
    ]


def indicator_spec() -> list[Indicator]:
    """The feature indicators in their fixed order: on, partial and issue conditions over facts."""
    media = _n("n_streams") > 0
    return [
        Indicator("sip", _n("n_messages") > 0, issue=(_n("n_requests") > 0) & (_n("n_responses") == 0)),
        Indicator("h323", _c("has_h323"), issue=_c("h323_fault")),
        Indicator("iwf", _c("iwf_paired"), partial=_c("has_h323") & (_n("n_messages") > 0), issue=_c("iwf_differs")),
        Indicator("sip-i", _c("isup_decoded"), partial=_c("has_isup"), issue=_c("isup_fault")),
        Indicator("ims", _n("n_markers") >= 3, partial=_n("n_markers") > 0, issue=(_c("ok_without_service_route") & (_c("mk_path") | _c("mk_p_associated_uri"))) | (_c("has_desired") & ~_c("has_confirmed") & (_n("n_markers") > 0))),
        Indicator("rtp", media, partial=_c("sdp_audio") & (_n("n_streams") == 0), issue=_c("one_way") | _c("lossy") | _c("gapped")),
        Indicator("rtcp", _c("has_rtcp"), partial=media & ~F.coalesce("has_rtcp", F.lit(False)), issue=_c("rtcp_loss")),
        Indicator("srtp", _c("srtp_stream"), partial=_c("sdp_secure"), issue=_c("sdp_secure") & _c("clear_stream") & ~_c("srtp_stream")),
        Indicator("dtls-srtp", _n("n_dtls") > 0, partial=_c("has_fingerprint"), issue=_c("dtls_stalled")),
        Indicator("t38", _c("sdp_t38") | _c("t38_stream"), issue=(_c("sdp_t38") & (_c("image_port_0") | _c("s488"))) | _c("d_t38_asymmetry")),
        Indicator("dtmf-rfc4733", _c("has_dtmf"), issue=_c("d_dtmf_pt_mismatch") | _c("d_dtmf_missing_one_leg")),
        Indicator("100rel", (_n("n_prack") > 0) | _c("has_rseq"), partial=_c("rel_supported") | _c("rel_required"), issue=_c("s420") | _c("d_100rel_warn") | (_c("rel_required") & _c("has_18x") & ~(_c("has_rseq") | (_n("n_prack") > 0)))),
        Indicator("session-timers", _c("has_timer"), partial=_c("timer_supported"), issue=_c("s422") | _c("d_session_timer_conflict") | _c("timer_self_conflict")),
        Indicator("update-method", _n("n_update") > 0, partial=_c("update_allowed"), issue=_c("update_refused")),
        Indicator("precondition", _c("has_desired") & _c("has_confirmed"), partial=_c("mk_preconditions") | _c("precondition_supported"), issue=_c("s580") | (_c("s420") & _c("precondition_required")) | (_c("has_desired") & ~_c("has_confirmed"))),
        Indicator("dns", _n("n_dns") > 0, partial=_c("dns_blocking"), issue=_c("dns_timeout") | _c("dns_slow") | _c("dns_error")),
        Indicator("diameter", _c("diameter_linked"), partial=_n("n_diameter") > 0, issue=_c("diameter_failed") | _c("diameter_unanswered")),
        Indicator("stun-ice", _n("n_checks") > 0, partial=_c("ice_attrs"), issue=(_n("n_checks") > 0) & ~_c("check_ok")),
        Indicator("tcp-transport", _c("has_tcp") & ~_c("has_udp"), partial=_c("has_tcp"), issue=_c("tcp_repeats")),
        Indicator("tls-transport", _c("has_tls") & ~_c("has_clear"), partial=_c("has_tls")),
        Indicator("ipv6", _c("v6_signalling") & ~_c("v4_signalling"), partial=_c("v6_signalling") | _c("v6_media"), issue=_c("v6_signalling") & _c("v4_media") & ((_n("n_streams") == 0) | _c("sip_failed"))),
        Indicator("registration", _c("register_ok"), partial=(_n("n_register") > 0) & ~_c("register_answered"), issue=((_n("n_register") > 0) & _c("register_answered") & ~_c("register_ok")) | _c("nonce_repeated")),
        Indicator("topology-hiding", _c("d_any") & (_c("d_header_rewritten") | _c("d_header_stripped")), partial=(_n("max_legs") >= 2) & ~F.coalesce("d_header_rewritten", F.lit(False)), issue=_c("d_private_ip_leak")),
        Indicator("transcoding", _c("d_codec_transcoding"), partial=_c("d_codec_narrowed"), issue=_c("s488") | _c("s606") | _c("s415")),
        Indicator("early-media", _c("early_183"), partial=_c("mk_p_early_media"), issue=_c("d_early_media_183")),
        Indicator("refer-transfer", _n("n_refer") > 0, partial=_c("refer_allowed"), issue=_c("refer_refused") | _c("sipfrag_failed") | ((_n("n_refer") > 0) & (_n("n_notify") == 0))),
        Indicator("history-info", _c("has_history"), partial=_c("supports_history"), issue=_c("d_history") | _c("history_too_large")),
    ]


# Indicators that have a rule of their own.
COVERED_INDICATORS = ["early-media", "t38", "precondition", "dns", "stun-ice", "dtls-srtp", "diameter", "refer-transfer", "rtp", "registration", "100rel", "session-timers", "dtmf-rfc4733", "topology-hiding"]


def advice_rules(t: dict[str, DataFrame]) -> list[Rule]:
    """The 26 rules over the tables of an analysis. Wording is left to the reader of rule ids."""
    from sigspark.operators import matching

    def codes(*names):
        return lambda: t["collapses"].where(F.col("code").isin(*names))

    def tags(*names):
        return lambda: t["diff_items"].where(F.col("tag").isin(*names))

    def state(key):
        return t["indicators"].where((F.col("key") == key) & (F.col("state") == "issue"))

    def or_indicator(rows: DataFrame, key: str) -> DataFrame:
        """Evidence rows, or the bare indicator where a capture has none."""
        got = told(rows)
        bare = state(key).join(got.select("capture_id").distinct(), "capture_id", "left_anti")
        return got.unionByName(told(bare.select("capture_id", F.col("key").alias("evidence"))))

    def told(rows: DataFrame) -> DataFrame:
        return with_subjects(rows).select("capture_id", "evidence", *SUBJECTS)

    facts = t["facts"]
    item_text = F.concat_ws(" ", "tag", "label")
    collapse_text = F.concat_ws(" ", "leg_id", "label")
    named = F.col("evidence")

    def as_evidence(df: DataFrame, *cols) -> DataFrame:
        return df.withColumn("evidence", F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))

    def oversize():
        a = told(as_evidence(codes("udp-fragmentation")(), "leg_id", "label"))
        return a.unionByName(told(as_evidence(tags("udp-frag-risk")(), "tag", "label")))

    def dns_stall():
        a = told(as_evidence(t["dns_stats"].where((F.col("n_timeouts") > 0) | (F.col("n_slow") > 0)), "request_qname"))
        return a.unionByName(told(as_evidence(codes("dns-blocking")(), "leg_id", "label")))

    def ice():
        bad = t["checks"].groupBy("capture_id").agg(F.count_if(F.col("state") == "succeeded").alias("ok"), F.count_if(F.col("state") == "failed").alias("bad")).where("ok = 0 AND bad > 0")
        a = bad.select("capture_id", F.lit("no check succeeded").alias("evidence"))
        return a.unionByName(t["handshakes"].where(~F.col("complete")).select("capture_id", F.concat_ws(" ", "pair", "stalled_after").alias("evidence")))

    def one_way():
        paired = t["call_legs"].join(t["calls"].where(F.col("state") == "paired").select("capture_id", "call_no"), ["capture_id", "call_no"], "left_semi")
        rows = t["one_way"].join(t["stream_legs"], [c for c in t["one_way"].columns])
        rows = rows.join(paired.select("capture_id", "leg_id").withColumn("_p", F.lit(1)), ["capture_id", "leg_id"], "left")
        return rows.select("capture_id", "leg_id", F.concat_ws(" ", "src", "dst", "leg_id").alias("evidence"), F.when(F.col("_p") == 1, "crit").otherwise("warn").alias("severity"))

    def quality():
        s = t["streams"].where((F.col("loss_pct") >= 1) | (F.col("max_jitter_ms") >= 30) | (F.col("max_gap_ms") >= 300) | (F.col("mos") <= 3.6))
        known = s.join(t["stream_legs"].select("capture_id", "src", "dst", "ssrc", "leg_id").distinct(), ["capture_id", "src", "dst", "ssrc"], "left") if "stream_legs" in t else s
        got = told(known.withColumn("evidence", F.concat_ws(" ", "src", "dst", F.col("mos").cast("string"))))
        rtcp = t["rtcp"].where(F.col("fraction_lost") / 256.0 * 100 >= 5).join(got.select("capture_id").distinct(), "capture_id", "left_anti")
        return got.unionByName(told(rtcp.select("capture_id", F.col("block_ssrc").cast("string").alias("evidence"))))

    diameter_code = F.coalesce("response_result_code", "response_experimental_code")
    return [
        Rule("invite-timer-b-no-100", "crit", codes("never-arrived"), collapse_text),
        Rule("udp-oversize", "warn", oversize, named),
        Rule("two-hundred-no-ack", "crit", codes("ack-not-landing"), collapse_text),
        Rule("route-set-mismatch", "warn", lambda: matching.ack_targets(t["leg_messages"]), F.concat_ws(" ", "contact_host", "ack_host")),
        Rule("prack-100rel-asymmetry", "warn", tags("100rel-asymmetry"), item_text),
        Rule("session-timer-conflict", "warn", tags("session-timer-conflict"), item_text),
        Rule("dtmf-pt-mismatch", "warn", tags("dtmf-pt-mismatch", "dtmf-missing-one-leg"), item_text),
        Rule("codec-ptime-renegotiation", "notice", tags("codec-narrowed", "codec-transcoding", "ptime-mismatch"), item_text),
        Rule("early-media-asymmetry", "notice", lambda: or_indicator(as_evidence(tags("early-media-183")(), "tag", "label"), "early-media"), named),
        Rule("private-ip-leak", "crit", tags("private-ip-leak"), item_text),
        Rule("t38-asymmetry", "warn", lambda: or_indicator(as_evidence(tags("t38-asymmetry")(), "tag", "label"), "t38"), named),
        Rule("one-way-audio", "warn", one_way, named),
        Rule("rtp-quality", "warn", quality, named),
        Rule("dns-egress-stall", "warn", dns_stall, named),
        Rule("missing-service-route", "warn", lambda: facts.where(F.col("ok_without_service_route") & (F.col("n_markers") > 0)), F.lit("registration answered without a service route")),
        Rule("precondition-unconfirmed", "warn", lambda: or_indicator(facts.where(F.col("has_desired") & ~F.col("has_confirmed")).withColumn("evidence", F.lit("desired, never confirmed")), "precondition"), named),
        Rule("ice-dtls-failure", "crit", ice, named),
        Rule("digest-auth-loop", "warn", lambda: matching.auth_loops(t["leg_messages"]), F.concat_ws(" ", "leg_id", "method")),
        Rule("cancel-race", "notice", lambda: matching.cancel_races(t["leg_messages"]), F.col("leg_id")),
        Rule("diameter-rx-failure", "warn", lambda: t["diameter"].where((diameter_code >= 3000) | (F.col("timed_out") & (F.col("request_command") == "AA"))), F.concat_ws(" ", "request_command", diameter_code.cast("string"))),
        Rule("refer-transfer-failure", "warn", lambda: matching.transfer_failures(t["leg_messages"]), F.col("leg_id")),
        Rule("box-wide-storm", "crit", lambda: t["burst_windows"], F.concat_ws(" ", F.col("start_ts").cast("string"), F.col("n_entities").cast("string"))),
        Rule("slow-far-end", "warn", codes("slow-far-end"), collapse_text),
        Rule("release-cause", "notice", lambda: t["causes"].where(F.col("severity") != "info"), F.concat_ws(" ", "source", F.col("code").cast("string"))),
        Rule("correlation-ambiguous", "notice", lambda: t["calls"].where(F.col("state") == "ambiguous"), F.col("call_no").cast("string")),
        Rule("indicator-issue", "notice", lambda: t["indicators"].where((F.col("state") == "issue") & ~F.col("key").isin(COVERED_INDICATORS)), F.col("key")),
    ]
