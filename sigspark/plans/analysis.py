"""The whole analysis of captures: from messages and decoded tables to findings and advice.

Every stage is a DataFrame over all captures at once, keyed by ``capture_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark import schemas
from sigspark.functions.redact import (
    mask_headers,
    mask_uris,
    mask_user,
    redact_credentials,
    redact_headers,
)
from sigspark.functions.sip import explode_sdp, header, parse_messages
from sigspark.operators import linkage, manip, media, repeats, rollups, rowdiff
from sigspark.operators.classify import rank_fixes, indicators, run_rules, score_labels
from sigspark.operators.dialogs import group_flows, sip_dialogs, transactions
from sigspark.operators.matching import (
    ice_keys,
    link_ids,
    match_keys,
    names_to_legs,
    sdp_endpoints,
)
from sigspark.operators.ordered import number_rows
from sigspark.operators.pairing import pair_fifo, pair_named
from sigspark.plans import findings as fnd
from sigspark.plans import profile_sip as profile
from sigspark.session import stage


@dataclass
class Capture:
    """Input tables; only ``messages`` (``schemas.RAW_MESSAGES``) is required."""

    messages: DataFrame
    q931: DataFrame | None = None
    rtp: DataFrame | None = None
    rtcp: DataFrame | None = None
    dns: DataFrame | None = None
    diameter: DataFrame | None = None
    stun: DataFrame | None = None
    dtls: DataFrame | None = None
    rules: DataFrame | None = None
    isup: DataFrame | None = None  # capture_id, msg_id, isup
    fixes: DataFrame | None = None  # rule_id, vendor, fix: what may be done about the advice of a rule


def redact(messages: DataFrame, mask_numbers: bool = False) -> DataFrame:
    """Credentials always, numbers on request, in raw text and in what is parsed from it.

    Runs on raw text before parsing, so derived columns inherit the masks; the user parts are
    masked once more where legs are built.
    """
    out = messages.withColumn("raw", redact_credentials(F.col("raw")))
    return out.withColumn("raw", mask_uris(F.col("raw"))) if mask_numbers else out


def mask_parsed(messages: DataFrame) -> DataFrame:
    out = messages.withColumn("headers", mask_headers(redact_headers(F.col("headers"))))
    for c in ("request_uri", "from_uri", "to_uri", "contact"):
        out = out.withColumn(c, mask_uris(F.col(c)))
    return out


def mask_legs(legs: DataFrame) -> DataFrame:
    out = legs
    for c in ("from_uri", "to_uri"):
        out = out.withColumn(c, mask_uris(F.col(c)))
    for c in ("from_user", "to_user"):
        out = out.withColumn(c, mask_user(F.col(c)))
    return out


def with_row_id(rows: DataFrame, named: list[str], name: str) -> DataFrame:
    """``rows`` written once with a ``row_id`` of their own, equal packets too: a hash of ``named`` and a running number."""
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in named]))
    return stage(rows.withColumn("row_id", F.concat_ws("-", key, F.monotonically_increasing_id().cast("string"))), name)


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def analyze(capture: Capture, mask_numbers: bool = False) -> dict[str, DataFrame]:
    """All result tables by name."""
    spark = capture.messages.sparkSession
    t: dict[str, DataFrame] = {}
    parsed = parse_messages(redact(capture.messages, mask_numbers))
    if capture.isup is not None:
        parsed = parsed.join(capture.isup, ["capture_id", "msg_id"], "left")
    else:
        parsed = parsed.withColumn("isup", F.lit(None).cast(schemas.ISUP))
    if mask_numbers:
        parsed = mask_parsed(parsed)
    ok = parsed.where(F.col("method").isNotNull() | F.col("status").isNotNull())
    t["warnings"] = parsed.where(F.col("method").isNull() & F.col("status").isNull()).select(
        "capture_id", "msg_id", F.lit("not a recognisable message").alias("warning")
    )
    t["messages"] = messages = stage(ok, "messages")

    sip_legs, leg_messages = sip_dialogs(messages)
    t["leg_messages"] = leg_messages = stage(leg_messages, "leg-messages")
    h_legs = None
    legs = sip_legs.withColumn("guid", F.lit(None).cast("string")).withColumn("call_ref", F.lit(None).cast("int"))
    if capture.q931 is not None:
        h_legs, t["q931_leg_messages"] = group_flows(capture.q931)
        h_legs = stage(h_legs, "q931-legs")
        legs = legs.unionByName(h_legs, allowMissingColumns=True)
    t["legs"] = legs = stage(mask_legs(legs) if mask_numbers else legs, "legs")
    sip_legs = legs.where(F.col("protocol") == "sip")
    t["transactions"] = transactions(leg_messages)

    nodes = profile.leg_nodes(sip_legs, leg_messages, h_legs)
    extra = None
    if h_legs is not None:
        cross = profile.cross_protocol_pairs(sip_legs, leg_messages, h_legs)
        extra = linkage.pair_candidates(cross, ["capture_id"])
    linked = linkage.link(nodes, profile.SIP_LINK, extra)
    calls = number_rows(linked["calls"], ["capture_id"], ["start_ts", "first_ord"], "c", "call_no")
    t["calls"] = calls = stage(calls, "calls")
    t["call_legs"] = call_legs = stage(
        linked["call_nodes"].withColumnRenamed("node_id", "leg_id").join(calls.select("capture_id", "root", "call_no"), ["capture_id", "root"]).select("capture_id", "call_no", "leg_id", "t"),
        "call-legs",
    )
    t["pairings"], t["pair_signals"], t["candidates"] = linked["accepted"], linked["pair_signals"], linked["candidates"]
    t["ambiguous"] = linked["ambiguous"]

    pairs = linked["accepted"].select("capture_id", F.col("ingress").alias("ingress_leg"), F.col("egress").alias("egress_leg"))
    pairs = pairs.join(call_legs.select("capture_id", F.col("leg_id").alias("ingress_leg"), "call_no"), ["capture_id", "ingress_leg"])
    profiles = rowdiff.leg_profiles(sip_legs, leg_messages)
    t["diff_items"] = items = stage(rowdiff.diff_calls(pairs, profiles), "diff-items")
    t["diff_groups"] = rowdiff.group_items(items, ["capture_id"], "call_no", "call_no", 8)

    t.update(repeats.retransmission_report(leg_messages))
    t["collapses"] = collapses = stage(t["collapses"], "collapses")
    t["collapse_groups"] = repeats.collapse_groups(collapses)

    sdp_media, _ = explode_sdp(leg_messages, ["capture_id", "msg_id"])
    endpoints = sdp_endpoints(sdp_media, messages, leg_messages)
    streams = None
    if capture.rtp is not None:
        streams = media.stream_totals(capture.rtp, endpoints)
        t["streams"] = streams = stage(media.number_streams(streams), "streams")
        t["stream_legs"] = bridge = media.stream_legs(streams, endpoints)
        t["one_way"] = media.one_way_streams(streams, bridge)
        streams = streams.join(t["one_way"].withColumn("one_way", F.lit(True)), media.STREAM, "left").withColumn("one_way", F.coalesce("one_way", F.lit(False)))
        t["dtmf_events"] = media.dtmf_events(capture.rtp)
        audio = endpoints.where(F.col("type") == "audio").select("capture_id", "leg_id").where(F.col("leg_id").isNotNull()).distinct()
        t["media_findings"] = media.stream_findings(streams, bridge, legs, call_legs, audio)
    else:
        t["streams"] = _empty(spark, "capture_id string, src string, dst string, loss_pct double, max_jitter_ms double, max_gap_ms double, mos double")
        t["one_way"] = _empty(spark, "capture_id string, src string, dst string, ssrc bigint")
        t["stream_legs"] = _empty(spark, "capture_id string, src string, dst string, ssrc bigint, leg_id string")
    t["rtcp"] = capture.rtcp if capture.rtcp is not None else _empty(spark, schemas.RTCP)

    _aux(capture, t, spark, messages, leg_messages, legs, call_legs, sdp_media)

    facts = profile.message_facts(messages)
    for part in (
        profile.leg_facts(legs), profile.call_facts(calls, call_legs, legs), profile.address_facts(messages),
        profile.stream_facts(streams, capture.rtcp, spark),
        profile.aux_facts(spark, t["dns"] if capture.dns is not None else None, t["diameter"] if capture.diameter is not None else None,
                          t["checks"] if capture.stun is not None else None, t["handshakes"] if capture.dtls is not None else None),
        profile.diff_facts(items, spark), profile.repeat_facts(collapses, leg_messages),
    ):
        facts = facts.join(part, "capture_id", "left")
    # text logs carry no media, so its absence says something of packet captures only
    facts = facts.withColumn("is_pcap", F.lit(capture.rtp is not None))
    t["facts"] = facts = stage(facts, "facts")
    t["indicators"] = indicators(facts, ["capture_id"], profile.indicator_spec())
    t["scenarios"] = score_labels(facts, ["capture_id"], profile.scenario_tests())
    t["causes"] = fnd.release_causes(messages, capture.q931)
    t["advice"], t["rule_matches"] = run_rules(profile.advice_rules(t))
    t["vendors"] = profile.vendors(messages)
    if capture.fixes is not None:
        # the fixes of every rule that has spoken, those for equipment of the capture first
        spoken = t["rule_matches"].select("capture_id", "rule_id").distinct()
        t["fixes"] = rank_fixes(spoken.join(capture.fixes, "rule_id"), t["vendors"])
    t["findings"] = stage(fnd.all_findings(t), "findings")
    t["finding_refs"] = fnd.finding_refs(t)
    t["message_severity"] = fnd.message_severity(t)
    t["stats"] = rollups.capture_stats(messages)
    if capture.rules is not None:
        t["rule_verdicts"] = manip.rules_vs_changes(
            manip.with_expected(capture.rules).select("rule_id", F.lower("target_header").alias("header"), "expected"),
            items.select("capture_id", "call_no", "tag", manip.item_header(F.col("tag"), F.col("label")).alias("header")),
        )
        t["rule_conflicts"] = manip.rule_conflicts(capture.rules)
    return t


def _aux(capture: Capture, t, spark, messages, leg_messages, legs, call_legs, sdp_media) -> None:
    """Name lookups, policy exchanges, connectivity checks and handshakes, tied to dialogs."""
    ends = messages.groupBy("capture_id").agg(F.max("ts").alias("capture_end"))
    flow = ["capture_id", "txid", "client", "cport", "server", "vport"]
    if capture.dns is not None:
        r = F.col("is_response")
        d = capture.dns.withColumn("client", F.when(r, F.col("dst")).otherwise(F.col("src"))).withColumn("cport", F.when(r, F.col("dport")).otherwise(F.col("sport")))
        d = d.withColumn("server", F.when(r, F.col("src")).otherwise(F.col("dst"))).withColumn("vport", F.when(r, F.col("sport")).otherwise(F.col("dport")))
        d = with_row_id(d, ["capture_id", "ts", "src", "sport", "txid", "is_response", "qname"], "dns-rows")
        last = capture.dns.select("capture_id", "ts").unionByName(messages.select("capture_id", "ts")).groupBy("capture_id").agg(F.max("ts").alias("capture_end"))
        t["dns"], t["dns_orphans"] = pair_named(d, flow, ~F.col("is_response"), "ts", "row_id", "qname", capture_end=last)
        t["dns"] = stage(t["dns"], "dns")
        t["dns_stats"] = rollups.exchange_stats(t["dns"], ["capture_id", "request_qname"])
        t["dns_evidence"] = rollups.exchange_aliases(t["dns"])
        t["dns_legs"] = names_to_legs(t["dns"], messages, leg_messages, "request_qname")
    else:
        t["dns"] = _empty(spark, "capture_id string")
        t["dns_stats"] = _empty(spark, "capture_id string, request_qname string, n_total bigint, n_timeouts bigint, n_slow bigint, max_latency_us bigint, n_failures bigint")
    if capture.diameter is not None:
        q = F.col("is_request")
        d = capture.diameter.withColumn("client", F.when(q, F.col("src")).otherwise(F.col("dst"))).withColumn("cport", F.when(q, F.col("sport")).otherwise(F.col("dport")))
        d = d.withColumn("server", F.when(q, F.col("dst")).otherwise(F.col("src"))).withColumn("vport", F.when(q, F.col("dport")).otherwise(F.col("sport")))
        d = with_row_id(d, ["capture_id", "ts", "src", "sport", "hop_by_hop", "is_request", "command"], "diameter-rows")
        ex, _ = pair_fifo(d, ["capture_id", "hop_by_hop", "command", "app_id", "client", "cport", "server", "vport"], q, "ts", "row_id", capture_end=ends)
        ex = ex.withColumnRenamed("command", "request_command")
        sip = leg_messages.select("capture_id", "leg_id", fnd.icid(header(F.col("headers"), "p-charging-vector")).alias("icid")).where(F.col("icid").isNotNull()).distinct()
        own = F.coalesce("request_charging_id", "response_charging_id", "request_session_id")
        ex = ex.withColumn("link_id", own)
        links = link_ids(ex, sip, "link_id", "icid")
        t["diameter_links"] = links
        t["diameter_legs"] = ex.select("capture_id", "link_id", "request_row_id").join(links, ["capture_id", "link_id"]).join(sip, ["capture_id", "icid"]).select("capture_id", "request_row_id", "leg_id", "icid", "how").distinct()
        linked = links.select("capture_id", "link_id").distinct().withColumn("linked", F.lit(True))
        t["diameter"] = stage(ex.join(linked, ["capture_id", "link_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "diameter")
        t["diameter_activity"] = rollups.activity(t["diameter"], ["capture_id", "app_id", "request_command"])
        t["diameter_findings"] = fnd.diameter_findings(t["diameter"], t["diameter_legs"], legs)
    else:
        t["diameter"] = _empty(spark, "capture_id string, request_command string, response_result_code int, response_experimental_code int, timed_out boolean")
    if capture.stun is not None:
        t["checks"] = stage(rollups.pair_rollup(capture.stun), "checks")
        keys = ice_keys(sdp_media, leg_messages)
        flows = capture.stun.withColumn("pair", rollups.pair_key()).select("capture_id", "pair", "src", "sport", "dst", "dport", "username").distinct()
        t["check_legs"] = match_keys(flows, keys, ["capture_id", "pair"])
    else:
        t["checks"] = _empty(spark, "capture_id string, pair string, state string, n_requests bigint")
    if capture.dtls is not None:
        t["handshakes"] = stage(rollups.handshake_rollup(capture.dtls), "handshakes")
    else:
        t["handshakes"] = _empty(spark, "capture_id string, pair string, complete boolean, stalled_after string")
