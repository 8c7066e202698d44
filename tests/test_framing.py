"""Messages framed in byte streams, against framing in order."""

import random
import re

import pytest
import sipkit
from pyspark.sql import functions as F

from sigspark.operators import reassembly
from sigspark.session import stage

START = rb"(?:[A-Z][A-Z0-9.!%*_+`'~-]{0,31}[ \t]+[^\s:]+:\S*[ \t]+SIP/\d{1,3}\.\d{1,3}[ \t]*\r?(?=\n|$)|SIP/\d{1,3}\.\d{1,3}[ \t]+\d{1,10}(?:[ \t][^\n]*)?\r?(?=\n|$))"


def text_frames(stream):
    out, at = [], 0
    while at < len(stream):
        while at < len(stream) and stream[at] in b"\r\n":
            at += 1
        if not re.match(START, stream[at:]):
            nxt = re.compile(rb"\n(?=" + START + rb")").search(stream, at)
            if not nxt:
                break
            at = nxt.end()
            continue
        gap = re.compile(rb"\n\r?\n").search(stream, at)
        if not gap:
            break
        m = re.search(rb"(?i)\n(?:content-length|l)\s*:\s*(\d+)", stream[at : gap.start() + 1])
        end = gap.end() + (int(m[1]) if m else 0)
        if end > len(stream):
            break
        out.append((at, end))
        at = end
    return out


def record_frames(stream):
    size = lambda i: int.from_bytes(stream[i + 1 : i + 4], "big")
    fits = lambda i: i + 20 <= len(stream) and stream[i] == 1 and size(i) >= 20 and size(i) % 4 == 0
    out, at = [], 0
    while at + 20 <= len(stream):
        if not fits(at):
            at = next((i for i in range(at + 1, len(stream)) if fits(i) and i + size(i) <= len(stream)), len(stream))
            continue
        if at + size(at) > len(stream):
            break
        out.append((at, at + size(at)))
        at += size(at)
    return out


def text_stream(rng, n):
    out = b""
    for _ in range(n):
        out += rng.choice([b"", b"", b"\r\n", b"\r\n\r\n", b"garbage", b"rubbish line\r\n", b"x\nSIP/2.0 100", b"\xff\xfe\n"])
        body = rng.choice([b"", b"hello", b"a\r\nSIP/2.0 200 OK\r\n\r\n", b"MESSAGE sip:a SIP/2.0\n\n", bytes(rng.randrange(256) for _ in range(rng.randint(0, 60)))])
        length = rng.choice([len(body), len(body), len(body), len(body) + 3, max(len(body) - 2, 0)])
        eol = rng.choice([b"\r\n", b"\n"])
        out += rng.choice([b"INVITE sip:a@b SIP/2.0", b"SIP/2.0 200 OK", b"SIP/2.0 486"]) + eol + b"Via: SIP/2.0/TCP h" + eol
        out += rng.choice([b"Content-Length: %d" % length, b"l : %d" % length, b"X: y"]) + eol + rng.choice([eol, eol, eol, b""]) + body
    return out


def record_stream(rng, n):
    out = b""
    for _ in range(n):
        out += rng.choice([b"", b"", bytes(rng.choice([0, 1, 20, 24, 255]) for _ in range(rng.randint(0, 30)))])
        body = bytes(rng.choice([0, 1, 20, 24, rng.randrange(256)]) for _ in range(4 * rng.randint(4, 20)))
        out += b"\x01" + (len(body) + 4 + rng.choice([0, 0, 0, 0, 8])).to_bytes(3, "big") + body
    return out


def segments(spark, rng, streams, one_byte_in):
    rows = []
    for name, stream in streams.items():
        at, n = 0, 0
        while at < len(stream):
            size = 1 if rng.random() < one_byte_in else rng.randint(1, 90)
            rows.append((name, n, sipkit.at(n), 5_000 + at, stream[at : at + size]))
            at, n = at + size, n + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "flow string, n int, ts timestamp, seq bigint, payload binary")
    return stage(reassembly.order_stream(df, ["flow"], F.col("seq")), "segments")


@pytest.mark.parametrize("limit", ["2000000", "100"])
@pytest.mark.parametrize(("make", "rule", "frames"), [(text_stream, reassembly.text_length, text_frames), (record_stream, reassembly.diameter_length, record_frames)])
def test_framing_equals_framing_in_order(spark, limit, make, rule, frames):
    rng = random.Random(21)
    streams = {f"f{i}": make(rng, rng.randint(1, 9)) for i in range(40)}
    streams["hot"] = make(rng, 120)  # a third of all bytes
    streams["noise"] = bytes(rng.randrange(256) for _ in range(3_000)) + b"".join(make(rng, 2) for _ in range(2))
    seg = segments(spark, rng, streams, 0.2)
    spark.conf.set("spark.sigspark.maxGroupRows", limit)
    try:
        rows = reassembly.frame_stream(seg, ["flow"], rule).collect()
    finally:
        spark.conf.unset("spark.sigspark.maxGroupRows")
    got = {}
    for r in sorted(rows, key=lambda r: r.start_byte):
        got.setdefault(r.flow, []).append((r.start_byte, r.end_byte))
        assert bytes(r.payload) == streams[r.flow][r.start_byte : r.end_byte] and r.msg_no == len(got[r.flow])
    wanted = {k: frames(v) for k, v in streams.items()}
    assert got == {k: v for k, v in wanted.items() if v} and sum(map(len, wanted.values())) > 100
    first = {(s.flow, s.start_byte, s.end_byte): s.ts for s in seg.collect()}
    for r in rows[:50]:
        assert r.ts == next(t for (f, a, b), t in first.items() if f == r.flow and a <= r.start_byte < b)
