"""The reference scenarios, all analysed in one job, and the outcome each must have."""

import pytest
import sipkit

from sigspark import schemas
from sigspark.plans.analysis import Capture, analyze


@pytest.fixture(scope="module")
def result(spark):
    caps = [f() for f in sipkit.ALL]
    # many small plans: compiling them takes longer than running them
    tiny = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in tiny}
    for k, v in tiny.items():
        spark.conf.set(k, v)

    def frame(attr, ddl):
        return spark.createDataFrame([r for c in caps for r in getattr(c, attr)], ddl)

    tables = analyze(Capture(
        messages=frame("rows", schemas.RAW_MESSAGES), q931=frame("q931", schemas.Q931), rtp=frame("rtp", schemas.RTP), dns=frame("dns", schemas.DNS),
        diameter=frame("diameter", schemas.DIAMETER), stun=frame("stun", schemas.STUN), dtls=frame("dtls", schemas.DTLS),
        isup=frame("isup", f"capture_id string, msg_id string, isup {schemas.ISUP}"),
    ))
    out = {n: [r.asDict(recursive=True) for r in df.collect()] for n, df in tables.items()}
    for k, v in before.items():
        spark.conf.set(k, v)
    return out


def of(result, table, name):
    return [r for r in result[table] if r["capture_id"] == name]


def codes(result, name):
    return {r["code"] for r in of(result, "collapses", name)}


COUNTS = {
    "basic-call": (14, 2, 1), "timer-b": (7, 1, 1), "late-response": (9, 1, 1), "big-invite": (5, 1, 1), "ack-lost": (9, 1, 1), "storm": (24, 8, 8),
    "ambiguous": (8, 3, 3), "register-auth": (4, 1, 0), "iwf-call": (7, 2, 1), "callcentre": (None, 12, 12), "ims-volte": (8, 2, 1), "dns-slow": (14, 2, 2), "t38-fax": (10, 1, 1),
}


@pytest.mark.parametrize("name", COUNTS)
def test_counts(result, name):
    messages, legs, calls = COUNTS[name]
    if messages is not None:
        assert len(of(result, "messages", name)) == messages
    assert len(of(result, "legs", name)) == legs
    assert len(of(result, "calls", name)) == calls


def test_basic_call(result):
    (call,) = of(result, "calls", "basic-call")
    assert call["state"] == "paired" and call["n_nodes"] == 2
    assert call["confidence"] == 982  # icid 450, origin 300, time 132 (30 of 250 ms), one user 50, rewritten 50
    assert {s["signal"] for s in of(result, "pair_signals", "basic-call")} == {"pcv-icid", "sdp-origin", "temporal", "user-parts", "via-rewrite"}
    assert {i["tag"] for i in of(result, "diff_items", "basic-call")} == {
        "header-stripped", "header-added", "header-rewritten", "from-rewritten", "codec-narrowed", "codec-transcoding", "ptime-mismatch",
        "dtmf-pt-mismatch", "100rel-asymmetry", "session-timer-changed", "session-timer-conflict", "early-media-183", "private-ip-leak",
    }
    assert any(f["severity"] == "crit" and f["category"] == "diff" for f in of(result, "findings", "basic-call"))
    assert {leg["state"] for leg in of(result, "legs", "basic-call")} == {"completed"}
    assert any(a["rule_id"] == "private-ip-leak" for a in of(result, "advice", "basic-call"))


@pytest.mark.parametrize(
    ("name", "code", "severity", "count"),
    [("timer-b", "never-arrived", "crit", 7), ("late-response", "slow-far-end", "warn", 3), ("big-invite", "udp-fragmentation", "crit", 5), ("ack-lost", "ack-not-landing", "crit", 6), ("dns-slow", "dns-blocking", "warn", 3)],
)
def test_repeat_causes(result, name, code, severity, count):
    rows = of(result, "collapses", name)
    assert {r["code"] for r in rows} == {code}
    assert {r["severity"] for r in rows} == {severity}
    assert {r["count"] for r in rows} == {count}


def test_timer_b_is_abandoned(result):
    assert [r["outcome"] for r in of(result, "collapses", "timer-b")] == ["abandoned"]
    assert [leg["state"] for leg in of(result, "legs", "timer-b")] == ["no-answer"]


def test_storm(result):
    assert codes(result, "storm") == {"box-wide-storm"}
    (window,) = of(result, "burst_windows", "storm")
    assert window["n_entities"] == 8 and window["n_rows"] == 16


def test_ambiguous(result):
    states = sorted(c["state"] for c in of(result, "calls", "ambiguous"))
    assert states == ["ambiguous", "unpaired", "unpaired"]
    assert any(f["severity"] == "notice" and f["category"] == "correlation" for f in of(result, "findings", "ambiguous"))


def test_register_secrets_are_gone(result):
    assert [leg["kind"] for leg in of(result, "legs", "register-auth")] == ["register"]
    assert [leg["state"] for leg in of(result, "legs", "register-auth")] == ["completed"]
    for m in of(result, "messages", "register-auth"):
        assert "deadbeefcafe" not in m["raw"] and "0badf00d" not in str(m["headers"])


def test_h323(result):
    (leg,) = of(result, "legs", "h323-call")
    assert leg["state"] == "completed" and leg["protocol"] == "h323" and leg["to_user"] == "33987654321"
    assert [c["state"] for c in of(result, "calls", "h323-call")] == ["unpaired"]


def test_cross_protocol(result):
    (call,) = of(result, "calls", "iwf-call")
    assert call["state"] == "paired" and call["confidence"] == 750
    assert {leg["leg_id"][0] for leg in of(result, "call_legs", "iwf-call")} == {"d", "g"}


def test_media(result):
    a, b = sorted(of(result, "streams", "rtp-loss"), key=lambda s: s["ssrc"])
    assert (a["packets"], a["expected"], a["lost"], a["duplicates"], a["out_of_order"]) == (367, 400, 33, 0, 0)
    assert a["loss_pct"] == 8.25 and a["n_gaps"] == 1 and a["max_gap_ms"] == 620.0 and a["codec"] == "PCMU"
    assert b["lost"] == 0 and 3.0 < b["max_jitter_ms"] <= 4.0 and b["mos"] > 4.0 > a["mos"]
    assert {f["title"] for f in of(result, "media_findings", "rtp-loss")} == {"severe packet loss"}
    assert of(result, "one_way", "rtp-loss") == []
    assert len({r["leg_id"] for r in of(result, "stream_legs", "rtp-loss")}) == 1


def test_dns(result):
    rows = {r["request_qname"]: r for r in of(result, "dns", "dns-slow")}
    assert rows["carrier.example.net"]["latency_us"] == 4000 and not rows["carrier.example.net"]["slow"]
    assert rows["_sip._udp.carrier.example.net"]["slow"]
    assert rows["one.carrier.example.net"]["timed_out"]
    assert rows["one.carrier.example.net"]["waited_us"] > 0
    named = {(r["request_qname"], r["leg_id"]) for r in of(result, "dns_legs", "dns-slow")}
    assert ("carrier.example.net", "d1") in named and ("_sip._udp.carrier.example.net", "d2") in named
    assert any(a["rule_id"] == "dns-egress-stall" for a in of(result, "advice", "dns-slow"))


def test_diameter(result):
    (row,) = of(result, "diameter", "diameter-rx")
    assert row["linked"] and row["response_result_code"] == 5003
    assert [(r["leg_id"], r["how"]) for r in of(result, "diameter_legs", "diameter-rx")] == [("d1", "exact")]
    titles = {f["title"] for f in of(result, "findings", "diameter-rx")}
    assert "policy request refused while the call failed" in titles
    assert any(a["rule_id"] == "diameter-rx-failure" for a in of(result, "advice", "diameter-rx"))


def test_checks(result):
    (pair,) = of(result, "checks", "ice-stun")
    assert (pair["n_requests"], pair["n_successes"], pair["state"], pair["min_rtt_us"], pair["n_unanswered"]) == (2, 1, "succeeded", 50000, 1)
    assert {r["leg_id"] for r in of(result, "check_legs", "ice-stun")} == {"d1"}
    (hs,) = of(result, "handshakes", "ice-stun")
    assert not hs["complete"] and hs["stalled_after"] == "ChangeCipherSpec"


SCENARIOS = {"callcentre": "call-centre", "ims-volte": "volte-5g", "ice-stun": "webrtc-ott", "t38-fax": "fax-service", "sipi-call": "carrier-interconnect"}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(result, name):
    (row,) = of(result, "scenarios", name)
    assert row["label"] == SCENARIOS[name], (row, of(result, "facts", name))


INDICATORS = {
    "basic-call": {"sip": "on", "dtmf-rfc4733": "issue", "session-timers": "issue", "topology-hiding": "issue", "transcoding": "on"},
    "timer-b": {"sip": "issue"}, "dns-slow": {"sip": "on", "dns": "issue"}, "rtp-loss": {"rtp": "issue"}, "ims-volte": {"ims": "on", "100rel": "on", "registration": "on", "precondition": "on"},
    "t38-fax": {"t38": "on"}, "ice-stun": {"stun-ice": "on", "dtls-srtp": "issue"}, "diameter-rx": {"diameter": "issue"}, "iwf-call": {"iwf": "on", "h323": "on"}, "callcentre": {"refer-transfer": "on"}, "sipi-call": {"sip-i": "issue"},
}


@pytest.mark.parametrize("name", INDICATORS)
def test_indicators(result, name):
    states = {r["key"]: r["state"] for r in of(result, "indicators", name)}
    assert len(states) == 27
    assert {k: states[k] for k in INDICATORS[name]} == INDICATORS[name]


def sequential_legs(rows):
    """The dialog rule, one message after the other."""
    legs, out = [], []
    for f, t in rows:
        hit = next((i for i, tag in enumerate(legs) if (tag in (f, t) if tag else not f)), None)
        if hit is None:
            legs.append(f)
            hit = len(legs) - 1
        out.append(hit)
    return out


def test_mid_dialog_matches_the_sequential_rule(result):
    rows = sorted(of(result, "leg_messages", "mid-dialog"), key=lambda r: r["ord"])
    want = sequential_legs([(r["from_tag"], r["to_tag"]) for r in rows])
    assert [int(r["leg_id"][1:]) - 1 for r in rows] == want


def test_garbage_is_reported(result):
    assert len(of(result, "warnings", "garbage")) >= 3
    assert len(of(result, "warnings", "garbage")) + len(of(result, "messages", "garbage")) == 7


def test_every_message_is_in_one_leg_and_every_leg_in_one_call(result):
    ids = [(r["capture_id"], r["msg_id"]) for r in result["leg_messages"]]
    assert len(ids) == len(set(ids)) == len(result["messages"])
    legs = [(r["capture_id"], r["leg_id"]) for r in result["call_legs"]]
    assert len(legs) == len(set(legs)) == len([x for x in result["legs"] if x["kind"] == "call"])


def test_advice_is_capped_per_rule(result):
    from collections import Counter

    n = Counter((a["capture_id"], a["rule_id"]) for a in result["advice"])
    assert max(n.values()) <= 8 and len(result["rule_matches"]) >= len(result["advice"])
