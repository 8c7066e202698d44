"""Findings of all modules in one shape: capture_id, severity, category, title, subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.sip import header
from sigspark.operators.classify import worst_severity
from sigspark.operators.pairing import near_intervals

COLUMNS = ["capture_id", "severity", "category", "title", "subject"]


def icid(value: Column) -> Column:
    quoted = F.regexp_extract(value, r'(?i)icid-value\s*=\s*"([^"]*)"', 1)
    plain = F.regexp_extract(value, r'(?i)icid-value\s*=\s*([^;,\s"]+)', 1)
    return F.nullif(F.trim(F.when(quoted != "", quoted).otherwise(plain)), F.lit(""))


def shape(df: DataFrame, severity: Column | str, category: str, title: Column | str, subject: Column) -> DataFrame:
    def text(x):
        return F.lit(x) if isinstance(x, str) else x

    return df.select("capture_id", text(severity).alias("severity"), F.lit(category).alias("category"), text(title).alias("title"), subject.cast("string").alias("subject"))


def exchange_findings(stats: DataFrame) -> DataFrame:
    """Lookups that time out, are slow or fail, per name."""
    rows = [
        shape(stats.where("n_timeouts > 0"), "warn", "transport", "lookup never answered", F.col("request_qname")),
        shape(stats.where("n_slow > 0"), "warn", "transport", "slow lookup", F.col("request_qname")),
        shape(stats.where("n_failures > 0"), "notice", "transport", "lookup failed", F.col("request_qname")),
    ]
    total = stats.groupBy("capture_id").agg(F.sum("n_total").alias("n"))
    rows.append(shape(total.where("n > 0"), "info", "transport", "lookups observed", F.col("n")))
    return reduce(DataFrame.unionByName, rows)


def check_findings(checks: DataFrame, handshakes: DataFrame, check_legs: DataFrame | None = None) -> DataFrame:
    """No check succeeded (grave with two or more checks or a dialog behind them), stalled handshakes."""
    per = checks.groupBy("capture_id").agg(F.count_if(F.col("state") == "succeeded").alias("ok"), F.sum("n_requests").alias("n"))
    if check_legs is not None:
        tied = check_legs.select("capture_id").distinct().withColumn("_leg", F.lit(1))
        per = per.join(tied, "capture_id", "left")
    else:
        per = per.withColumn("_leg", F.lit(None).cast("int"))
    grave = (F.col("n") >= 2) | (F.col("_leg") == 1)
    failed = shape(per.where("ok = 0 AND n > 0"), F.when(grave, "crit").otherwise("warn"), "transport", "no connectivity check succeeded", F.col("n"))
    good = shape(per.where("ok > 0"), "info", "transport", "connectivity checks succeeded", F.col("ok"))
    stalled = shape(handshakes.where(~F.col("complete")), "warn", "transport", "media handshake stalled", F.col("pair"))
    return failed.unionByName(good).unionByName(stalled)


def pairing_findings(calls: DataFrame, pair_signals: DataFrame) -> DataFrame:
    """A notice per ambiguous call, an info per pairing with its signals as text."""
    amb = shape(calls.where(F.col("state") == "ambiguous"), "notice", "correlation", "ambiguous correlation, no guess made", F.col("call_no"))
    # a pair has at most one row per signal
    text = pair_signals.groupBy("capture_id", "ingress", "egress", "score").agg(F.concat_ws("; ", F.sort_array(F.collect_list("signal"))).alias("signals"))
    info = shape(text, "info", "correlation", F.concat(F.lit("legs paired: "), F.col("signals")), F.concat_ws("-", "ingress", "egress"))
    return amb.unionByName(info)


def diameter_findings(exchanges: DataFrame, links: DataFrame, legs: DataFrame) -> DataFrame:
    """Exchanges tied to a call; refusals with, or next to, a failing call."""
    info = shape(links.select("capture_id", "icid").distinct(), "info", "transport", "policy exchange tied to the call", F.col("icid"))
    code = F.coalesce("response_result_code", "response_experimental_code")
    bad = exchanges.where(code >= 3000)
    failing = legs.where((F.col("protocol") == "sip") & F.col("state").isin("failed", "canceled", "no-answer"))
    hit = bad.join(links, ["capture_id", "request_row_id"]).join(failing.select("capture_id", "leg_id"), ["capture_id", "leg_id"], "left_semi")
    with_call = shape(hit, "warn", "transport", "policy request refused while the call failed", F.col("leg_id")).distinct()
    rest = bad.join(hit.select("capture_id", "request_row_id"), ["capture_id", "request_row_id"], "left_anti")
    near = near_intervals(rest, failing, 5, ["capture_id"], "response_ts", "request_row_id", "start_ts", "end_ts", "leg_id")
    beside = shape(near, "warn", "transport", "policy request refused next to a failing call", F.coalesce("latest_id", F.col("n_open").cast("string")))
    return info.unionByName(with_call).unionByName(beside)


# Fixed values (Q.850): causes of a normal end.
NORMAL_CAUSES = [16, 31]


def release_causes(messages: DataFrame, q931: DataFrame | None) -> DataFrame:
    """Release causes by source (Reason header, encapsulated message, Q.931) and code."""
    reason = header(F.col("headers"), "reason")
    cause = F.regexp_extract(reason, r"(?i)Q\.850\s*;.*?cause\s*=\s*(\d+)", 1).try_cast("int")
    a = messages.select("capture_id", F.lit("reason").alias("source"), cause.alias("code"))
    b = messages.select("capture_id", F.lit("isup").alias("source"), F.col("isup.cause_code").alias("code"))
    both = a.unionByName(b)
    if q931 is not None:
        both = both.unionByName(q931.select("capture_id", F.lit("q931").alias("source"), F.col("cause_code").alias("code")))
    out = both.where(F.col("code").isNotNull()).groupBy("capture_id", "source", "code").agg(F.count(F.lit(1)).alias("n"))
    from sigspark.plans.profile_sip import NETWORK_FAULTS

    sev = F.when(F.col("code").isin(NORMAL_CAUSES), "info").when(F.col("code").isin(NETWORK_FAULTS), "warn").otherwise("notice")
    return out.withColumn("severity", sev)


def all_findings(t: dict[str, DataFrame]) -> DataFrame:
    """The findings of every module, merged and numbered by severity then order."""
    from sigspark.operators.ordered import number_rows
    from sigspark.operators.rollups import severity_rank

    parts = [
        shape(t["diff_items"].where(F.col("severity").isin("warn", "crit")), F.col("severity"), "diff", F.col("label"), F.col("call_no")),
        shape(t["collapses"].where(F.col("severity").isin("warn", "crit")), F.col("severity"), "retransmission", F.col("code"), F.col("leg_id")),
        pairing_findings(t["calls"], t["pair_signals"]),
        exchange_findings(t["dns_stats"]),
        check_findings(t["checks"], t["handshakes"], t.get("check_legs")),
    ]
    if "media_findings" in t:
        parts.append(shape(t["media_findings"], F.col("severity"), "media", F.col("title"), F.coalesce("leg_id", F.concat_ws("-", "src", "dst"))))
    if "diameter_findings" in t:
        parts.append(t["diameter_findings"])
    merged = reduce(DataFrame.unionByName, parts).dropDuplicates(COLUMNS)
    ranked = merged.withColumn("rank", severity_rank(F.col("severity")))
    return number_rows(ranked, ["capture_id"], ["rank", "category", "title", "subject"], "f", "finding_id").drop("rank")


# Titles of findings by what their subject names.
ABOUT_CALLS = ["ambiguous correlation, no guess made"]
ABOUT_LEGS = ["policy request refused while the call failed", "policy request refused next to a failing call"]
ABOUT_NAMES = ["lookup never answered", "slow lookup", "lookup failed"]
ABOUT_CHECKS = ["no connectivity check succeeded", "connectivity checks succeeded"]
ABOUT_POLICY, ABOUT_HANDSHAKES = "policy exchange tied to the call", "media handshake stalled"


def finding_refs(t: dict[str, DataFrame]) -> DataFrame:
    """(capture_id, finding_id, kind, id): the legs (kind ``leg``) and calls (``call``) that each finding is about.

    A subject that is a name, a pair of addresses, a charging id or a pair of legs is led back to legs by the tables
    that tied it to them. A finding about the whole capture has no row.
    """
    f = t["findings"].select("capture_id", "finding_id", "category", "title", "subject")
    out = ["capture_id", "finding_id"]

    def refs(rows: DataFrame, kind: str, ref: str) -> DataFrame:
        return rows.select(*out, F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("id"))

    def by_subject(rows: DataFrame, links: DataFrame, subject: Column) -> DataFrame:
        ties = links.select("capture_id", subject.cast("string").alias("subject"), "leg_id").where("leg_id IS NOT NULL").distinct()
        return refs(rows.join(ties, ["capture_id", "subject"]), "leg", "leg_id")

    legs = t["legs"].select("capture_id", F.col("leg_id").alias("subject"))
    media = f.where(F.col("category") == "media")
    named = f.where(F.col("category").isin("retransmission", "media") | F.col("title").isin(ABOUT_LEGS))
    pairs = t["pair_signals"].select("capture_id", F.concat_ws("-", "ingress", "egress").alias("pair"), F.explode(F.array("ingress", "egress")).alias("leg_id"))
    parts = [
        refs(f.where((F.col("category") == "diff") | F.col("title").isin(ABOUT_CALLS)), "call", "subject"),
        # what is no leg is a pair of addresses or a count
        refs(named.join(legs, ["capture_id", "subject"], "left_semi"), "leg", "subject"),
        by_subject(f.where((F.col("category") == "correlation") & ~F.col("title").isin(ABOUT_CALLS)), pairs, F.col("pair")),
    ]
    if "stream_legs" in t:
        parts.append(by_subject(media, t["stream_legs"], F.concat_ws("-", "src", "dst")))
    if "dns_legs" in t:
        parts.append(by_subject(f.where(F.col("title").isin(ABOUT_NAMES)), t["dns_legs"], F.col("request_qname")))
    if "diameter_legs" in t:
        parts.append(by_subject(f.where(F.col("title") == ABOUT_POLICY), t["diameter_legs"], F.col("icid")))
    if "check_legs" in t:
        parts.append(by_subject(f.where(F.col("title") == ABOUT_HANDSHAKES), t["check_legs"], F.col("pair")))
        tied = t["check_legs"].select("capture_id", "leg_id").distinct()
        parts.append(refs(f.where(F.col("title").isin(ABOUT_CHECKS)).join(tied, "capture_id"), "leg", "leg_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def message_severity(t: dict[str, DataFrame]) -> DataFrame:
    """Gravest severity per message: findings about its leg or call, every match of the rules filling the gaps."""
    found = t["finding_refs"].join(t["findings"].select("capture_id", "finding_id", "severity"), ["capture_id", "finding_id"])
    found = found.select("capture_id", *[F.when(F.col("kind") == k, F.col("id")).alias(c) for k, c in (("leg", "leg_id"), ("call", "call_no"))], "severity", F.lit("finding").alias("source"))
    advised = t["rule_matches"].select("capture_id", "leg_id", "call_no", "severity", F.lit("advice").alias("source"))
    both = found.unionByName(advised)
    calls = t["call_legs"].select("capture_id", F.col("call_no").cast("string").alias("call_no"), "leg_id")
    by_call = both.where("call_no IS NOT NULL").drop("leg_id").join(calls, ["capture_id", "call_no"])
    ids = both.where("leg_id IS NOT NULL").drop("call_no").unionByName(by_call.drop("call_no"))
    legs = worst_severity(ids, ["capture_id", "leg_id"])
    return t["leg_messages"].select("capture_id", "msg_id", "leg_id").join(legs, ["capture_id", "leg_id"]).select("capture_id", "msg_id", "severity")
