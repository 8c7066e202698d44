"""Findings led back to legs, calls and messages; ids of equal packets."""

from sigspark.plans.analysis import with_row_id
from sigspark.plans.findings import finding_refs, message_severity


def test_findings_reach_their_legs_and_messages(spark):
    found = [
        ("f1", "crit", "diff", "codec", "1"), ("f2", "notice", "correlation", "ambiguous correlation, no guess made", "2"),
        ("f3", "info", "correlation", "legs paired: x-header", "L1-L2"), ("f4", "warn", "transport", "slow lookup", "a.example"),
        ("f5", "info", "transport", "lookups observed", "3"), ("f6", "crit", "transport", "no connectivity check succeeded", "2"),
        ("f7", "warn", "transport", "media handshake stalled", "p|q"), ("f8", "info", "transport", "policy exchange tied to the call", "icid-1"),
        ("f9", "warn", "media", "loss", "10.0.0.1-10.0.0.2"), ("f10", "warn", "retransmission", "slow", "L4"),
        ("f11", "warn", "transport", "policy request refused next to a failing call", "2"),
    ]
    frame = lambda rows, ddl: spark.createDataFrame([("c", *r) for r in rows], "capture_id string, " + ddl)
    t = {
        "findings": frame(found, "finding_id string, severity string, category string, title string, subject string"),
        "legs": frame([(f"L{i}",) for i in range(1, 7)], "leg_id string"),
        "pair_signals": frame([("L1", "L2", "x-header"), ("L1", "L2", "sdp-origin")], "ingress string, egress string, signal string"),
        "stream_legs": frame([("10.0.0.1", "10.0.0.2", 1, "L5"), ("10.0.0.1", "10.0.0.2", 2, None)], "src string, dst string, ssrc bigint, leg_id string"),
        "dns_legs": frame([("a.example", "L3"), ("3", "L6")], "request_qname string, leg_id string"),
        "diameter_legs": frame([("icid-1", "L2")], "icid string, leg_id string"),
        "check_legs": frame([("p|q", "L4"), ("r|s", "L5")], "pair string, leg_id string"),
        "rule_matches": frame([("L6", None, "warn"), ("L3", None, "crit")], "leg_id string, call_no string, severity string"),
        "call_legs": frame([(1, "L1"), (1, "L2"), (2, "L6")], "call_no int, leg_id string"),
        "leg_messages": frame([(i, f"L{i}") for i in range(1, 7)], "msg_id int, leg_id string"),
    }
    refs = finding_refs(t)
    got = sorted((r.finding_id, r.kind, r.id) for r in refs.collect())
    assert got == sorted([
        ("f1", "call", "1"), ("f2", "call", "2"), ("f3", "leg", "L1"), ("f3", "leg", "L2"), ("f4", "leg", "L3"), ("f6", "leg", "L4"), ("f6", "leg", "L5"),
        ("f7", "leg", "L4"), ("f8", "leg", "L2"), ("f9", "leg", "L5"), ("f10", "leg", "L4"),
    ])
    severity = {r.msg_id: r.severity for r in message_severity(t | {"finding_refs": refs}).collect()}
    assert severity == {1: "crit", 2: "crit", 3: "warn", 4: "crit", 5: "crit", 6: "notice"}


def test_equal_packets_have_ids_of_their_own(spark):
    rows = with_row_id(spark.createDataFrame([("c", 1), ("c", 1), ("c", 2), (None, None)], "capture_id string, n int").repartition(3), ["capture_id", "n"], "rows")
    first, again = ([r.row_id for r in rows.orderBy("row_id").collect()] for _ in range(2))
    assert len(set(first)) == 4 and first == again
