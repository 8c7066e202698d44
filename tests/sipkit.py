"""Small hand-written captures for the tests: one builder for dialogs, one function per scenario."""

from __future__ import annotations

import datetime as dt

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
PHONE, OUTSIDE, INSIDE, CORE, RESOLVER = "198.51.100.10", "203.0.113.5", "10.9.0.5", "203.0.113.80", "10.9.0.53"


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(microseconds=round(seconds * 1e6))


def sdp(addr, port, codecs, ptime=20, origin=None, session="77001", proto="RTP/AVP", kind="audio", extra=()):
    """``codecs``: (payload type, name/rate) pairs."""
    lines = ["v=0", f"o=- {session} 1 IN IP4 {origin or addr}", "s=-", f"c=IN IP4 {addr}", "t=0 0"]
    lines.append(f"m={kind} {port} {proto} " + " ".join(str(pt) for pt, _ in codecs))
    lines += [f"a=rtpmap:{pt} {name}" for pt, name in codecs if name]
    if ptime:
        lines.append(f"a=ptime:{ptime}")
    return "\r\n".join([*lines, *extra, "a=sendrecv"]) + "\r\n"


G711 = [(0, "PCMU/8000"), (101, "telephone-event/8000")]


class Leg:
    """Renders the messages of one dialog between two addresses."""

    def __init__(self, cap, call_id, caller, callee, src, dst, from_host="pbx.example.com", to_host="far.example.net", transport="UDP"):
        self.cap, self.call_id, self.src, self.dst, self.transport = cap, call_id, src, dst, transport
        self.frm, self.to = f"<sip:{caller}@{from_host}>;tag=f-{call_id}", f"<sip:{callee}@{to_host}>"
        self.to_tag, self.target = f";tag=t-{call_id}", f"sip:{callee}@{dst}"
        self.contact = f"<sip:{caller}@{src}:5060>"

    def _text(self, first, method, cseq, branch, tagged, headers, body, ctype):
        via = f"SIP/2.0/{self.transport} {self.src}:5060;branch=z9hG4bK{branch}-{self.call_id}"
        lines = [first, f"Via: {via}", f"From: {self.frm}", f"To: {self.to}{self.to_tag if tagged else ''}", f"Call-ID: {self.call_id}", f"CSeq: {cseq} {method}"]
        lines += [f"{n}: {v}" for n, v in headers]
        if body:
            lines.append(f"Content-Type: {ctype}")
        lines.append(f"Content-Length: {len(body or '')}")
        return "\r\n".join(lines) + "\r\n\r\n" + (body or "")

    def req(self, t, method, cseq=1, branch="a", tagged=False, headers=(), body=None, ctype="application/sdp", contact=True, hops=70, target=None, back=False):
        hs = [("Max-Forwards", hops), *([("Contact", self.contact)] if contact else []), *headers]
        raw = self._text(f"{method} {target or self.target} SIP/2.0", method, cseq, branch, tagged, hs, body, ctype)
        self.cap.add(t, self.dst if back else self.src, self.src if back else self.dst, raw, self.transport)
        return self

    def res(self, t, status, method="INVITE", cseq=1, branch="a", tagged=True, headers=(), body=None, contact=None, ctype="application/sdp"):
        hs = [*([("Contact", f"<{contact}>")] if contact else []), *headers]
        raw = self._text(f"SIP/2.0 {status} Reason", method, cseq, branch, tagged, hs, body, ctype)
        self.cap.add(t, self.dst, self.src, raw, self.transport)
        return self


class Capture:
    def __init__(self, name):
        self.name, self.rows = name, []
        self.q931, self.rtp, self.dns, self.diameter, self.stun, self.dtls, self.isup = [], [], [], [], [], [], []

    def add(self, t, src, dst, raw, transport="UDP", sport=5060, dport=5060):
        n = len(self.rows) + 1
        self.rows.append((self.name, f"s{n}", n, at(t), src, dst, sport, dport, transport.lower(), raw))

    def leg(self, *a, **k):
        return Leg(self, *a, **k)

    def media(self, src, sport, dst, dport, ssrc, count, pt=0, start=1.3, drop=(), jitter=lambda i: 0.0, event=None):
        for i in range(count):
            if i in drop:
                continue
            self.rtp.append((self.name, len(self.rtp) + 1, at(start + 0.02 * i + jitter(i)), src, dst, sport, dport, ssrc, (65500 + i) % 65536, 160 * i, pt, i == 0, 172, None, None, None))


def basic_call(name="basic-call"):
    """A call through a border box; every change a diff can name is in it."""
    c = Capture(name)
    offer = sdp(PHONE, 40000, [(0, "PCMU/8000"), (8, "PCMA/8000"), (18, "G729/8000"), (101, "telephone-event/8000")], 20, "192.168.10.20", "8000001")
    onward = sdp(INSIDE, 20000, [(0, "PCMU/8000"), (18, "G729/8000"), (96, "telephone-event/8000")], 30, "192.168.10.20", "8000001")
    far = sdp(CORE, 30000, [(18, "G729/8000"), (96, "telephone-event/8000")], 30, session="5551212")
    near = sdp(OUTSIDE, 21000, G711, 20, session="7770001")
    icid = "icid-value=mark7f3a91c2;orig-ioi=pbx.example.com"
    a = c.leg("in-1", "+33123456789", "+33987654321", PHONE, OUTSIDE)
    b = c.leg("eg-1", "+33900000123", "+33987654321", INSIDE, CORE, "box.example.net", "core.example.net")
    allow = ("Allow", "INVITE, ACK, CANCEL, BYE, UPDATE, REFER")
    a.req(0.0, "INVITE", body=offer, headers=[allow, ("Supported", "100rel, timer"), ("Require", "100rel"), ("Session-Expires", "1800;refresher=uac"), ("Min-SE", "1200"), ("P-Charging-Vector", icid), ("X-Internal-Cause", "trunk-a"), ("User-Agent", "Asterisk PBX 18.9.0")])
    a.res(0.01, 100, tagged=False)
    b.req(0.03, "INVITE", body=onward, hops=69, headers=[allow, ("Supported", "timer"), ("Session-Expires", "900;refresher=uas"), ("Min-SE", "900"), ("P-Asserted-Identity", "<sip:+33123456789@box.example.net>"), ("P-Charging-Vector", icid + ";term-ioi=core.example.net"), ("User-Agent", "BorderBox/8.4.0")])
    b.res(0.045, 100, tagged=False)
    b.res(0.4, 183, body=far, contact=f"sip:x@{CORE}:5060")
    a.res(0.5, 180, contact=f"sip:x@{OUTSIDE}:5060")
    b.res(1.2, 200, body=far, contact=f"sip:x@{CORE}:5060")
    a.res(1.22, 200, body=near, contact=f"sip:x@{OUTSIDE}:5060")
    a.req(1.23, "ACK", tagged=True, branch="b", target=f"sip:x@{OUTSIDE}:5060")
    b.req(1.24, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}:5060")
    a.req(11.0, "BYE", 2, "c", True, contact=False, headers=[("Reason", "Q.850;cause=16")])
    b.req(11.01, "BYE", 2, "c", True, contact=False, headers=[("Reason", "Q.850;cause=16")])
    b.res(11.03, 200, "BYE", 2, "c")
    a.res(11.04, 200, "BYE", 2, "c")
    return c


def repeat_times(n):
    """Start times of a request repeated with doubling intervals from half a second."""
    out, step = [0.0], 0.5
    while len(out) < n:
        out.append(out[-1] + step)
        step *= 2
    return out


def timer_b():
    c = Capture("timer-b")
    leg = c.leg("tb-1", "1001", "2002", INSIDE, CORE)
    for t in repeat_times(7):
        leg.req(t, "INVITE", body=sdp(INSIDE, 20100, G711))
    return c


def late_response():
    c = Capture("late-response")
    leg = c.leg("lr-1", "1001", "2002", INSIDE, CORE)
    for t in repeat_times(3):
        leg.req(t, "INVITE", body=sdp(INSIDE, 20200, G711))
    leg.res(1.9, 100, tagged=False).res(2.0, 180).res(3.0, 200, contact=f"sip:x@{CORE}", body=sdp(CORE, 30200, G711))
    leg.req(3.02, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
    leg.req(9.0, "BYE", 2, "c", True).res(9.1, 200, "BYE", 2, "c")
    return c


def big_invite():
    c = Capture("big-invite")
    leg = c.leg("bi-1", "1001", "2002", INSIDE, CORE)
    for t in repeat_times(5):
        leg.req(t, "INVITE", body=sdp(INSIDE, 20300, G711), headers=[("History-Info", "<sip:hop@example.net>;index=1." + "9" * 60) for _ in range(14)])
    return c


def ack_lost():
    c = Capture("ack-lost")
    leg = c.leg("al-1", "1001", "2002", INSIDE, CORE)
    leg.req(0, "INVITE", body=sdp(INSIDE, 20400, G711)).res(0.02, 100, tagged=False).res(0.3, 180)
    for t in repeat_times(6):
        leg.res(1.0 + t, 200, contact=f"sip:x@{CORE}", body=sdp(CORE, 30400, G711))
    return c


def storm():
    c = Capture("storm")
    for i in range(8):
        leg = c.leg(f"st-{i}", f"10{i:02d}", f"20{i:02d}", INSIDE, CORE)
        for t in repeat_times(3):
            leg.req(0.05 * i + t, "INVITE", body=sdp(INSIDE, 21000 + 2 * i, G711))
    c.rows.sort(key=lambda r: r[3])
    return c


def ambiguous():
    """Two equal ingress legs and one egress leg that could belong to either."""
    c = Capture("ambiguous")
    for i, t in ((1, 0.0), (2, 0.1)):
        leg = c.leg(f"am-{i}", "+33123456789", "+33987654321", PHONE, OUTSIDE)
        leg.req(t, "INVITE", body=sdp(PHONE, 42000 + 2 * i, G711, session="5550001")).res(t + 0.005, 100, tagged=False).res(t + 0.18, 180)
    eg = c.leg("am-e", "+33123456789", "+33987654321", INSIDE, CORE, "box.example.net", "core.example.net")
    eg.req(0.14, "INVITE", hops=69, body=sdp(INSIDE, 22000, G711, session="5550001")).res(0.15, 100, tagged=False)
    return c


def register_auth():
    c = Capture("register-auth")
    leg = c.leg("ra-1", "alice", "alice", PHONE, OUTSIDE)
    leg.req(0, "REGISTER")
    leg.res(0.02, 401, "REGISTER", headers=[("WWW-Authenticate", 'Digest realm="r", nonce="n1"')])
    leg.req(0.05, "REGISTER", 2, "b", headers=[("Authorization", 'Digest username="alice", nonce="n1", response="deadbeefcafe0123", cnonce="0badf00d"')])
    leg.res(0.07, 200, "REGISTER", 2, "b")
    return c


def h323_call(name="h323-call"):
    c = Capture(name)
    for i, (t, kind, back, cause) in enumerate([(0, "SETUP", 0, None), (0.1, "CALL PROCEEDING", 1, None), (0.5, "ALERTING", 1, None), (2.0, "CONNECT", 1, None), (9.0, "RELEASE COMPLETE", 0, 16)]):
        ends = (CORE, INSIDE, 1720, 30001) if back else (INSIDE, CORE, 30001, 1720)
        c.q931.append((name, f"h{i}", at(t), ends[0], ends[1], ends[2], ends[3], kind, 77, "33123456789" if kind == "SETUP" else None, "33987654321" if kind == "SETUP" else None, cause, None))
    return c


def iwf_call():
    c = h323_call("iwf-call")
    leg = c.leg("iw-1", "+33123456789", "+33987654321", PHONE, OUTSIDE)
    leg.req(0.05, "INVITE", body=sdp(PHONE, 42100, G711)).res(0.1, 100, tagged=False).res(0.6, 180).res(2.1, 200, body=sdp(OUTSIDE, 42200, G711), contact=f"sip:x@{OUTSIDE}")
    leg.req(2.2, "ACK", tagged=True, branch="b", target=f"sip:x@{OUTSIDE}").req(9.1, "BYE", 2, "c", True).res(9.2, 200, "BYE", 2, "c")
    return c


def rtp_loss():
    c = Capture("rtp-loss")
    leg = c.leg("rl-1", "1001", "2002", PHONE, CORE)
    leg.req(0, "INVITE", body=sdp(PHONE, 40100, G711)).res(0.1, 180).res(1.2, 200, body=sdp(CORE, 30100, G711), contact=f"sip:x@{CORE}")
    leg.req(1.22, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}").req(12, "BYE", 2, "c", True).res(12.1, 200, "BYE", 2, "c")
    c.media(PHONE, 40100, CORE, 30100, 111, 400, drop=set(range(60, 90)) | {7, 200, 201})
    c.media(CORE, 30100, PHONE, 40100, 222, 400, jitter=lambda i: 0.0 if i % 2 else 0.004)
    return c


def dns_slow():
    c = Capture("dns-slow")
    name, srv = "carrier.example.net", "_sip._udp.carrier.example.net"

    def dns(t, port, txid, q, kind, response=False, answers=()):
        ends = (RESOLVER, 53, INSIDE, port) if response else (INSIDE, port, RESOLVER, 53)
        c.dns.append((c.name, at(t), *ends, txid, response, q, kind, "NOERROR" if response else None, list(answers)))

    dns(0.0, 35120, 1, name, "NAPTR")
    dns(0.004, 35120, 1, name, "NAPTR", True)
    dns(0.005, 35121, 2, srv, "SRV")
    dns(2.405, 35121, 2, srv, "SRV", True, [("x", "SRV", 300, "one." + name)])
    dns(2.41, 35122, 3, "one." + name, "A")
    for i, (t0, answer) in enumerate(((0.01, 2.45), (0.02, 2.465))):
        leg = c.leg(f"ds-{i}", f"+3361000012{i}", f"+3398765432{i}", INSIDE, CORE, "box.example.net", name)
        for t in repeat_times(3):
            leg.req(t0 + t, "INVITE", target=f"sip:x@{name}", body=sdp(INSIDE, 24000 + 2 * i, G711, session=f"830{i}"))
        leg.res(answer, 100, tagged=False).res(answer + 0.15, 180).res(answer + 0.6, 200, contact=f"sip:x@{CORE}", body=sdp(CORE, 34000 + 2 * i, G711))
        leg.req(answer + 0.62, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
    c.rows.sort(key=lambda r: r[3])
    return c


def diameter_rx():
    c = Capture("diameter-rx")
    leg = c.leg("dx-1", "alice", "bob", PHONE, CORE)
    leg.req(0, "INVITE", headers=[("P-Charging-Vector", "icid-value=charge-00042-abcdef")], body=sdp(PHONE, 40300, G711)).res(0.5, 403)
    ends = [(INSIDE, 40000, CORE, 3868), (CORE, 3868, INSIDE, 40000)]
    for i, (t, q, code) in enumerate([(0.1, True, None), (0.2, False, 5003)]):
        c.diameter.append((c.name, at(t), *ends[i], q, "AA", 16777236, 99, "session-1", "CHARGE-00042-ABCDEF" if q else None, code, None))
    return c


def webrtc():
    c = Capture("ice-stun")
    ice = ["a=ice-ufrag:abcd", "a=fingerprint:sha-256 00:11", "a=candidate:1 1 udp 2130706431 198.51.100.10 50000 typ host"]
    leg = c.leg("we-1", "alice", "bob", PHONE, CORE)
    body = sdp(PHONE, 50000, [(111, "opus/48000")], proto="UDP/TLS/RTP/SAVPF", extra=ice)
    leg.req(0, "INVITE", body=body, headers=[("User-Agent", "JsSIP 3.1")]).res(0.3, 200, body=sdp(CORE, 51000, [(111, "opus/48000")], proto="UDP/TLS/RTP/SAVPF"), contact=f"sip:x@{CORE}")
    leg.req(0.32, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
    for t, tx, kind, back in [(0.4, "t1", "request", 0), (0.45, "t1", "success", 1), (0.5, "t2", "request", 0)]:
        ends = (CORE, 51000, PHONE, 50000) if back else (PHONE, 50000, CORE, 51000)
        c.stun.append((c.name, at(t), *ends, tx, kind, "wxyz:abcd", True if not back else None, None, None))
    for t, back, ct, step in [(0.6, 0, 22, "ClientHello"), (0.65, 1, 22, "ServerHello"), (0.7, 0, 20, None)]:
        ends = (CORE, 51000, PHONE, 50000) if back else (PHONE, 50000, CORE, 51000)
        c.dtls.append((c.name, at(t), *ends, ct, step, None, None))
    return c


def fax():
    c = Capture("t38-fax")
    leg = c.leg("fx-1", "1001", "2002", PHONE, CORE)
    leg.req(0, "INVITE", body=sdp(PHONE, 40400, [(0, "PCMU/8000")]), headers=[("User-Agent", "FaxGate 1")]).res(0.1, 100, tagged=False).res(1.0, 200, body=sdp(CORE, 30400, [(0, "PCMU/8000")]), contact=f"sip:x@{CORE}")
    leg.req(1.1, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
    image = lambda a, p: sdp(a, p, [("t38", None)], None, proto="udptl", kind="image", extra=["a=T38FaxVersion:0", "a=T38FaxMaxDatagram:400"])
    leg.req(5, "INVITE", 2, "c", True, body=image(PHONE, 40402)).res(5.1, 100, cseq=2, branch="c").res(5.3, 200, cseq=2, branch="c", body=image(CORE, 30402), contact=f"sip:x@{CORE}")
    leg.req(5.4, "ACK", 2, "d", True, target=f"sip:x@{CORE}").req(30, "BYE", 3, "e", True).res(30.1, 200, "BYE", 3, "e")
    return c


def call_centre():
    """Twelve overlapping calls to one number, a few given up, with transfers and diversions."""
    c = Capture("callcentre")
    for i in range(12):
        leg = c.leg(f"cc-{i}", f"+3361000{i:04d}", "+33800100200", PHONE, CORE)
        t = 0.7 * i
        leg.req(t, "INVITE", body=sdp(PHONE, 43000 + 2 * i, G711, session=f"9{i}"), headers=[("Diversion", "<sip:queue@example.net>")]).res(t + 0.05, 180)
        if i % 3 == 2:
            leg.req(t + 1.0, "CANCEL").res(t + 1.02, 200, "CANCEL").res(t + 1.04, 487).req(t + 1.06, "ACK", tagged=True)
        else:
            leg.res(t + 0.9, 200, contact=f"sip:x@{CORE}", body=sdp(CORE, 33000 + 2 * i, G711)).req(t + 0.92, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
            if i < 3:
                leg.req(t + 2, "REFER", 2, "r", True, headers=[("Refer-To", "<sip:9@x>")]).res(t + 2.1, 202, "REFER", 2, "r")
                leg.req(t + 2.2, "NOTIFY", 3, "n", True, body="SIP/2.0 200 OK", ctype="message/sipfrag").res(t + 2.3, 200, "NOTIFY", 3, "n")
            leg.req(t + 9, "BYE", 9, "z", True).res(t + 9.1, 200, "BYE", 9, "z")
    c.rows.sort(key=lambda r: r[3])
    return c


def volte():
    c = Capture("ims-volte")
    reg = c.leg("vo-r", "+33611111111", "+33611111111", PHONE, CORE)
    pani = ("P-Access-Network-Info", "3GPP-E-UTRAN-FDD;utran-cell-id-3gpp=208")
    reg.req(0, "REGISTER", headers=[pani, ("Path", "<sip:p.example.net;lr>")]).res(0.1, 200, "REGISTER", headers=[("Service-Route", "<sip:orig@s.example.net;lr>"), ("P-Associated-URI", "<sip:+33611111111@ims>")])
    leg = c.leg("vo-c", "+33611111111", "+33622222222", PHONE, CORE)
    codecs = [(96, "AMR-WB/16000"), (97, "telephone-event/16000")]
    pre = ["a=curr:qos local none", "a=des:qos mandatory local sendrecv"]
    leg.req(1, "INVITE", body=sdp(PHONE, 44000, codecs, extra=pre), headers=[pani, ("Route", "<sip:orig@s.example.net;lr>"), ("Supported", "100rel, precondition"), ("P-Charging-Vector", "icid-value=v1")])
    leg.res(1.1, 183, body=sdp(CORE, 34000, codecs, extra=[*pre, "a=conf:qos remote sendrecv"]), headers=[("RSeq", "1"), ("Require", "100rel")])
    leg.req(1.2, "PRACK", 2, "p", True).res(1.25, 200, "PRACK", 2, "p").res(2, 200, contact=f"sip:x@{CORE}").req(2.1, "ACK", tagged=True, branch="b", target=f"sip:x@{CORE}")
    return c


def sip_i():
    c = Capture("sipi-call")
    for i in range(6):
        leg = c.leg(f"si-{i}", f"+331{i}3456789", f"+{44 + 7 * i}20{i}7654321", "198.18.0.1", "198.19.0.2", "a.example.net", "b.example.net")
        leg.req(i * 30, "INVITE", hops=60, ctype="multipart/mixed;boundary=b1", body="--b1\r\nContent-Type: application/sdp\r\n\r\nv=0\r\n--b1\r\nContent-Type: application/isup;version=itu-t92+\r\nContent-Disposition: signal\r\n\r\nIAM\r\n--b1--\r\n")
        c.isup.append((c.name, f"s{len(c.rows)}", ("IAM", None, "4420", "33")))
        leg.res(i * 30 + 1, 503)
        c.isup.append((c.name, f"s{len(c.rows)}", ("REL", 34, None, None)))
    return c


def mid_dialog():
    """The capture starts inside dialogs; tags chain so that only the sequential rule decides."""
    c = Capture("mid-dialog")
    for i, (f, t) in enumerate([("A", "B"), ("B", "A"), ("C", "B"), ("D", "C"), ("A", "C"), ("B", "C"), ("E", None), (None, None), (None, "C"), ("D", "E")]):
        lines = ["OPTIONS sip:x@example.net SIP/2.0", "Via: SIP/2.0/UDP h;branch=z", "From: <sip:a@h>" + (f";tag={f}" if f else ""), "To: <sip:b@h>" + (f";tag={t}" if t else ""), "Call-ID: md", f"CSeq: {i} OPTIONS"]
        c.add(i, PHONE, CORE, "\r\n".join(lines) + "\r\n\r\n")
    return c


def garbage():
    """Torture: none of these may fail, the unreadable ones become warnings."""
    c = Capture("garbage")
    for i, raw in enumerate(["", "\x00\x01\x02", "INVITE", "INVITE sip:x SIP/2.0\r\nCSeq: abc\r\nVia\r\n:\r\n\r\n", "SIP/2.0 999\r\nCSeq: 99999999999999999999 INVITE\r\n\r\n", "OPTIONS sip:[::1] SIP/7.0\r\nFrom: \"\\\"<sip:@;tag=\r\nContent-Type: application/sdp\r\n\r\nm=audio x y z\r\nm=\r\na=rtpmap:\r\n", "NEWMETHOD sip:a;b?c SIP/2.0\r\nl: -5\r\nf: <sip:a@b>;tag=1\r\n  folded\r\n\r\n"]):
        c.add(i, PHONE, CORE, raw)
    return c


ALL = [basic_call, timer_b, late_response, big_invite, ack_lost, storm, ambiguous, register_auth, h323_call, iwf_call, rtp_loss, dns_slow, diameter_rx, webrtc, fax, call_centre, volte, sip_i, mid_dialog, garbage]
