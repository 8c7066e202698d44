"""Text logs, access logs, documents, reassembly, sinks, small scalar functions."""

import datetime as dt
import random

import sipkit
from pyspark.sql import functions as F

from sigspark import schemas
from sigspark.functions import net, redact, sip
from sigspark.functions.quality import estimate_mos
from sigspark.operators import classify, media, reassembly, rollups, search, textindex
from sigspark.sources import files, results, textlog


def write(folder, name, text):
    path = folder / name
    path.write_text(text, newline="")
    return str(path)


def box_log(rows):
    """Messages as the box log prints them: envelope, message, dashes."""
    out = []
    for _, _, _, ts, src, dst, *_, raw in rows:
        inside = src.startswith("10.") or src == sipkit.OUTSIDE
        here, peer, way = (src, dst, "sent to") if inside else (dst, src, "received from")
        out += [f"{ts.strftime('%b %d %H:%M:%S.%f')} On [0:0]{here}:5060 {way} {peer}:5060", raw.replace("\r\n", "\n").rstrip("\n"), "", "-" * 40]
    return "\n".join(out) + "\n"


def console_log(rows):
    return "\n".join(f"U {ts.strftime('%Y/%m/%d %H:%M:%S.%f')} {src}:5060 -> {dst}:5060\n{raw.replace(chr(13), '')}\n" for _, _, _, ts, src, dst, *_, raw in rows)


def test_three_log_layouts(spark, tmp_path):
    rows = sipkit.basic_call().rows
    write(tmp_path, "a.log", box_log(rows))
    write(tmp_path, "b.log", console_log(rows))
    write(tmp_path, "c.log", "\n".join(r[-1].replace("\r\n", "\n") + "\n" for r in rows[:7]))
    messages, warnings = textlog.read_logs(spark, str(tmp_path), 2024)
    got = {}
    for m in messages.orderBy("ord").collect():
        got.setdefault(m["capture_id"][-5:], []).append(m)
    assert {k: len(v) for k, v in got.items()} == {"a.log": 14, "b.log": 14, "c.log": 7}
    for name in ("a.log", "b.log"):
        for m, r in zip(got[name], rows, strict=True):
            assert (m["ts"], m["src"], m["dst"], m["sport"], m["transport"]) == (r[3], r[4], r[5], 5060, "udp")
            assert m["raw"].split("\r\n")[0] == r[-1].split("\r\n")[0]
            assert m["raw"].rstrip() == r[-1].rstrip()
    bare = got["c.log"]
    assert [m["ts"] for m in bare] == [dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=10 * i) for i in range(7)]
    assert (bare[0]["src"], bare[0]["dst"]) == (sipkit.PHONE, sipkit.OUTSIDE)
    assert (bare[1]["src"], bare[1]["dst"]) == (sipkit.OUTSIDE, sipkit.PHONE)
    assert warnings.count() == 0


def test_body_ends_where_the_next_message_starts(spark, tmp_path):
    first = "INVITE sip:a@b SIP/2.0\nCall-ID: 1\nContent-Length: 500\n\nv=0\nt=0 0\n"
    nested = "NOTIFY sip:a@b SIP/2.0\nCall-ID: 2\nContent-Type: message/sipfrag\nContent-Length: 16\n\nSIP/2.0 200 OK\n\n"
    write(tmp_path, "x.log", first + nested + "OPTIONS sip:a@b SIP/2.0\nCall-ID: 3\n\n")
    messages, warnings = textlog.read_logs(spark, str(tmp_path))
    rows = sip.parse_messages(messages).orderBy("ord").collect()
    assert [r["method"] for r in rows] == ["INVITE", "NOTIFY", "OPTIONS"]
    assert rows[1]["body"].strip() == "SIP/2.0 200 OK"
    (warning,) = warnings.collect()
    assert "declared length 500" in warning["warning"] and "next message" in warning["warning"]


def test_file_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(bytes.fromhex("a1b2c3d4") + b"x" * 20)
    (tmp_path / "b.bin").write_text("OPTIONS sip:a@b SIP/2.0\r\nCall-ID: x\r\n\r\n")
    (tmp_path / "c.log").write_bytes(bytes(range(256)))
    (tmp_path / "d.log").write_text("shopping list: milk, eggs")
    got = {r["path"][-5:]: r["format"] for r in files.classify_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "pcap", "b.bin": "text-log", "c.log": "unknown", "d.log": "unknown"}


def test_json_scan_keeps_bad_rows_as_warnings(spark, tmp_path):
    write(tmp_path, "a.json", '{"a": 1, "b": "x"}\nnot json\n{"a": 2, "b": "y"}\n')
    rows, warnings = files.read_table(spark, str(tmp_path), "a int, b string", "json")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and warnings.count() == 1


def test_access_log(spark):
    lines = [
        '2024-05-01T10:00:00Z 198.51.100.0 GET /page?x=1 200 12ms "Mozilla"', '2024-05-01T10:00:01Z 198.51.100.0 GET /a.css 200 1ms "Mozilla"',
        '2024-05-01T10:00:02Z 203.0.113.0 GET /wp-login.php 404 1ms "Mozilla"', '2024-05-01T10:00:03Z 203.0.113.9 GET /page 200 5ms "SomeBot/1"', "GET /old 200", "nonsense",
    ]
    rows, legacy = files.parse_access_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    t = rollups.traffic(rows).first()
    assert (t["requests"], t["bots"], t["probes"], t["humans"], t["views"], t["css_hits"], t["networks"], t["bot_networks"]) == (4, 2, 1, 2, 1, 1, 1, 2)
    assert (t["bot_share"], t["css_ratio"]) == (50, 100) and legacy.first()[0] == 1
    assert [(r["path"], r["views"]) for r in rollups.top_paths(rows).collect()] == [("/page", 1)]
    assert rollups.traffic(rows.limit(0)).first()["bot_share"] is None


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    t = F.col("t")
    assert one(spark, net.coarsen_ip(t), t="203.0.113.77") == "203.0.113.0"
    assert one(spark, net.coarsen_ip(t), t="2001:db8:1:2:3:4:5:6") == "2001:db8:1::"
    assert one(spark, net.coarsen_ip(t), t="::ffff:203.0.113.77") == "203.0.113.0"
    assert [one(spark, net.address_class(t), t=x) for x in ("192.0.2.1", "10.1.2.3", "100.64.0.1", "8.8.8.8", "fe80::1", "")] == ["documentation", "private", "cgnat", "public", "v6", "unknown"]
    assert one(spark, redact.mask_uris(t), t="sip:+33123456789@h and 33123456789") == "sip:+3312…89@h and 33123456789"
    assert one(spark, redact.mask_uris(t), t="tel:+33-612345678;x") == "tel:+33-6123…78;x"
    assert one(spark, redact.mask_digits(t), t="id 12345678 and 123") == "id 1234…78 and 123"
    assert one(spark, redact.mask_user(t), t="alice") == "alice"
    assert one(spark, sip.same_party(t, F.col("u")), t="0033123456789", u="+33 1 23 45 67 89") is True
    assert one(spark, sip.same_party(t, F.col("u")), t="0123", u="123") is True
    assert one(spark, sip.same_party(t, F.col("u")), t="1123456", u="2123457") is False
    assert one(spark, sip.split_quoted(t), t='"a, b" <sip:x,y@h>, <sip:z@h>') == ['"a, b" <sip:x,y@h>', "<sip:z@h>"]
    got = one(spark, sip.address_parts(t), t='"Bob B" <sip:bob@[2001:db8::1]:5060;lr>;tag=9')
    assert (got["uri"], got["user"], got["tag"], got["display"]) == ("sip:bob@[2001:db8::1]:5060;lr", "bob", "9", "Bob B")
    assert one(spark, estimate_mos(F.col("l"), F.col("j"), t), l=0.0, j=0.0, t="PCMU") == 4.39
    assert one(spark, estimate_mos(F.col("l"), F.col("j"), t), l=100.0, j=500.0, t="nothing") == 1.0
    h = one(spark, sip.rtp_header(t), t=bytes.fromhex("80e0ffff000000a0deadbeef"))
    assert (h["pt"], h["marker"], h["seq"], h["rtp_ts"], h["ssrc"]) == (96, True, 65535, 160, 0xDEADBEEF)
    assert one(spark, sip.rtp_header(t), t=b"\x80") is None


def test_multipart(spark):
    body = "--b1\r\nContent-Type: application/sdp\r\n\r\nv=0\r\n--b1\r\nContent-Type: application/isup;x=1\r\nContent-Disposition: signal\r\n\r\nIAM\r\n--b1--\r\n"
    df = spark.createDataFrame([(body, "multipart/mixed;boundary=b1")], "body string, content_type string")
    got = [(r["part_type"], r["disposition"], r["part_body"].strip()) for r in sip.split_parts(df).orderBy("part_no").collect()]
    assert got == [("application/sdp", "", "v=0"), ("application/isup", "signal", "IAM")]


def test_fragments(spark):
    rnd = random.Random(2)
    payload = bytes(rnd.randint(0, 255) for _ in range(500))
    rows = []
    for ip_id, cuts in ((1, [(0, 200), (150, 300), (300, 500)]), (2, [(0, 200), (300, 500)]), (3, [(0, 200)])):
        for a, b in cuts:
            rows.append(("c", "s", "d", ip_id, 17, a, b < 500, payload[a:b], sipkit.at(a / 1000), b - a))
    rnd.shuffle(rows)
    whole, bad = reassembly.reassemble_fragments(spark.createDataFrame(rows, schemas.FRAGMENTS), ["capture_id", "src", "dst", "ip_id", "proto"])
    (w,) = whole.collect()
    assert bytes(w["payload"]) == payload and w["ts"] == sipkit.at(0) and w["wire_bytes"] == 550
    assert sorted(r["ip_id"] for r in bad.collect()) == [2, 3]


def test_streams_are_ordered_and_framed(spark):
    texts = [r[-1].encode() for r in sipkit.basic_call().rows[:4]]
    blob = b"\r\n\r\nrubbish line\r\n" + b"".join(texts) + texts[0][:50]
    cuts = [0, 10, 400, 401, 900, 1500, len(blob)]
    cuts = sorted({c for c in cuts if c <= len(blob)})
    rows = [("c", "f", n, sipkit.at(n), 1000 + a, blob[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows.append(("c", "f", 99, sipkit.at(99), 1000 + cuts[1], blob[cuts[1] : cuts[2]]))  # a repeat
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id string, flow string, n int, ts timestamp, seq bigint, payload binary")
    seg = reassembly.order_stream(df, ["capture_id", "flow"], F.col("seq"))
    msgs = reassembly.frame_stream(seg, ["capture_id", "flow"], reassembly.text_length)
    got = msgs.orderBy("msg_no").collect()
    assert [bytes(r["payload"]) for r in got] == texts
    assert got[0]["ts"] == sipkit.at(1)
    spans = reassembly.message_segments(msgs, seg, ["capture_id", "flow"]).orderBy("msg_no").collect()
    for m, s in zip(got, spans, strict=True):
        hit = [i + 1 for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < m["end_byte"] and b > m["start_byte"]]
        assert (s["first_pos"], s["last_pos"]) == (hit[0], hit[-1])


def test_framing_rules():
    assert reassembly.prefixed_length(b"\x00\x03abc") == (2, 3) and reassembly.prefixed_length(b"\x00\x05ab")[1] == 0
    assert reassembly.diameter_length(b"\x01\x00\x00\x14" + b"x" * 16) == (0, 20)
    assert reassembly.diameter_length(b"\x07\x00\x00\x14")[1] == -1


def test_cheap_reject(spark):
    rows = [(b"x" * 20, 4000, 4002), (b"x" * 20, 5060, 4002), (b"x", 4000, 4002), (None, 4000, 4002)]
    df = spark.createDataFrame(rows, "payload binary, sport int, dport int")
    assert media.cheap_reject(df).count() == 1


def test_html_and_chunks(spark):
    html = "<html><head><title>T &amp; U</title></head><body><script>x()</script><h1>Top</h1><p>One.<br>Two &lt;3</p><h2>Sub</h2><ul><li>a</li><li>b</li></ul><!-- no --></body></html>"
    df = spark.createDataFrame([(1, html)], "id int, text string")
    text = files.docs_to_text(df, "html").first()["text"]
    assert text == "# Top\n\nOne.\nTwo <3\n\n## Sub\n\n- a\n\n- b"
    assert df.select(files.html_title(F.col("text"))).first()[0] == "T & U"
    cut = lambda t: [(r["heading"], r["body"]) for r in textindex.sections(spark.createDataFrame([(1, t)], "id int, text string"), "id").orderBy("chunk").collect()]
    assert cut(text) == [("Top", "One.\nTwo <3"), ("Sub", "- a\n\n- b")]
    assert cut("CHAPTER ONE\n\n4.2 Timers\nbody\n[unit]\nx=1\nTitle\n=====\nmore") == [("CHAPTER ONE > 4.2 Timers", "body"), ("unit", "x=1"), ("Title", "more")]
    assert cut("# Alpha\n\n# Beta\n") == [(None, "# Alpha\n\n# Beta")] and cut("") == [] and cut("\n \n") == []
    long = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(12)) + "x" * 2_000
    rows = textindex.sections(spark.createDataFrame([(7, "HEAD\n\n" + long), (7, "HEAD\n\n" + long), (None, None)], "doc int, text string"), "doc").collect()
    pieces = [r["body"] for r in rows]
    assert all(len(p) <= textindex.CHUNK + textindex.PIECE + textindex.OVERLAP for p in pieces) and all(f"Paragraph {i}." in " ".join(pieces) for i in range(12))
    assert {r["heading"] for r in rows} == {"HEAD"} and "".join(pieces).count("x") >= 2_000


def test_entities(spark):
    t = "&lt;&eacute;&#233;&#xE9;&#x1F600;&amp;lt;&nbsp;&unknown; & &#0; &#xD800; &#1114112; a&b; &ldquo;"
    (got,) = spark.createDataFrame([(t,)], "t string").select(files.decode_entities(F.col("t"))).first()
    assert got == "<ééé😀&lt; &unknown; & &#0; &#xD800; &#1114112; a&b; “"


def test_pages_as_form_feed_parts(spark):
    pages = textindex.split_pages(spark.createDataFrame([(1, "a\f \fb")], "doc int, text string"), "doc", "text").collect()
    assert [(p["page"], p["text"]) for p in pages] == [(1, "a"), (3, "b")]


def test_cited_passages_prefer_headings(spark):
    chunks = spark.createDataFrame([(1, "Session timers", "refresher interval"), (2, "Other", "refresher interval"), (3, "None", "nothing here")], "id int, heading string, body string")
    index = textindex.build_index(chunks, ["id"], F.col("body"), F.col("heading"))
    rules = spark.createDataFrame([("r", "session refresher timers")], "rule_id string, keywords string")
    assert [r["id"] for r in textindex.cite(index, rules, ["id"]).orderBy("rank").collect()] == [1, 2]


def test_search(spark):
    df = spark.createDataFrame(
        [("m1", "INVITE sip:bob", "sip:+33 123 456 789@h", ["PCMU"], 200, "33123456789"), ("m2", "BYE sip:bob", "sip:carol@h", ["G729"], 404, "")],
        "id string, line string, from string, codec array<string>, status int, digits string",
    )
    hits = lambda q: [(r["id"], r["field"]) for r in search.search(df, q, ["line", "from"], "id", digits_col="digits").orderBy("id").collect()]
    assert hits("bob") == [("m1", "line"), ("m2", "line")]
    assert hits("bob codec:g72") == [("m2", "line")]
    assert hits("3312-3456") == [("m1", "number")]
    assert hits("status:4 carol") == [("m2", "from")]
    assert hits("status:2") == [("m1", "filter")]
    assert hits('"bob carol"') == []
    assert search.read_search('a from:x "b c" from: zz:1') .terms == ["a", "b c", "zz:1"]


def test_sinks(spark, tmp_path):
    t = {"messages": spark.createDataFrame([("c1", "u1", "x"), ("c2", "u2", "y"), ("c3", None, "z")], "capture_id string, account string, v string")}
    results.write_results(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == 3
    results.write_results({"messages": t["messages"].where("capture_id = 'c1'").withColumn("v", F.lit("new"))}, str(tmp_path / "out"))
    assert {(r["capture_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()} == {("c1", "new"), ("c2", "y"), ("c3", "z")}
    assert [r["v"] for r in results.export_subject(t, "account", "u1")["messages"].collect()] == ["x"]
    assert sorted(r["v"] for r in results.erase_subject(t, "account", "u1")["messages"].collect()) == ["y", "z"]
    assert {(r["account"], r["v"]) for r in results.anonymise_subject(t["messages"], "account", "u2", ["account"]).collect()} == {("u1", "x"), ("", "y"), (None, "z")}
    now = F.lit("2024-02-01 00:00:01").cast("timestamp")
    meta = spark.createDataFrame([("c1", dt.datetime(2024, 1, 2)), ("c2", dt.datetime(2024, 1, 1)), ("c3", None)], "capture_id string, uploaded_at timestamp")
    report, kept = results.apply_retention(spark, t, meta, 30, now, dry=False)
    assert {r["fate"]: r["n"] for r in report.collect()} == {"keep": 1, "remove": 1, "skipped-undated": 1}
    assert sorted(r["capture_id"] for r in kept["messages"].collect()) == ["c1", "c3"]
    assert results.apply_retention(spark, t, meta, 0, now, dry=False)[0].first()["fate"] == "disabled"
    cat = results.catalogue(meta.withColumn("modified_at", F.lit("2024-03-01").cast("timestamp"))).collect()
    assert [r["capture_id"] for r in cat] == ["c3", "c1", "c2"]
    fb = spark.createDataFrame([(("p", "secret", 3),)], "context struct<page:string,user:string,counts:int>")
    assert results.scrub_context(fb).schema["context"].dataType.fieldNames() == ["page", "counts"]


def test_merge_findings(spark):
    ddl = "capture_id string, severity string, category string, title string, ids array<string>"
    a = spark.createDataFrame([("c", "warn", "x", "t", ["m1", "gone"]), ("c", "warn", "x", "t", ["m1", "gone"])], ddl)
    known = spark.createDataFrame([("c", "m1")], "capture_id string, id string")
    (row,) = classify.merge_findings([a, a], known, "ids").collect()
    assert row["ids"] == ["m1"]


def test_digest_and_kpis(spark):
    fb = spark.createDataFrame([(dt.datetime(2024, 12, 30), "bug", 4), (dt.datetime(2025, 1, 5), "bug", None)], "ts timestamp, kind string, rating int")
    (row,) = rollups.weekly_digest(fb).collect()
    assert (row["week"], row["n"], row["n_rated"], row["mean_rating"]) == ("2025-W01", 2, 1, 4.0)
    sent = spark.createDataFrame([("2025-W01",)], "week string")
    assert rollups.unsent_weeks(rollups.weekly_digest(fb), sent).count() == 0
    users = spark.createDataFrame([("u1", "paid"), ("u2", "free")], "user_id string, plan string").withColumn("created_at", F.current_timestamp()).withColumn("last_login_at", F.current_timestamp())
    caps = spark.createDataFrame([("team", None)], "owner_id string, uploaded_at timestamp")
    owner = spark.createDataFrame([("u2", "team")], "user_id string, owner_id string")
    k = rollups.kpis(users, caps, F.current_timestamp(), owner).first()
    assert (k["users"], k["activated"], k["activation_pct"], k["conversion_pct"], k["signups_7d"]) == (2, 1, 50, 50, 2)
