"""Datagrams of repeated ids, against putting fragments together one after the other."""

import random

import sipkit

from sigspark import schemas
from sigspark.operators import reassembly


def in_order(rows):
    """(key, ts, n, payload or None) with the rules applied fragment by fragment."""
    out, held = [], {}
    for key, ts, off, more, data in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        g = held.get(key)
        if g and (ts - g["last"]).total_seconds() > 30:
            out.append((key, g["ts"], len(g["parts"]), None))
            g = None
        g = held[key] = g or {"ts": ts, "parts": [], "end": None}
        g["last"] = ts
        g["parts"].append((off, data))
        if not more:
            g["end"] = off + len(data)
        if g["end"] is not None:
            covered = {x for o, d in g["parts"] for x in range(o, o + len(d))}
            if all(x in covered for x in range(g["end"])):
                buf = {}
                for o, d in sorted(g["parts"], key=lambda p: p[0]):
                    buf |= {o + k: b for k, b in enumerate(d)}
                out.append((key, g["ts"], len(g["parts"]), bytes(buf[x] for x in range(g["end"]))))
                held[key] = None
    return sorted(out + [(k, g["ts"], len(g["parts"]), None) for k, g in held.items() if g], key=repr)


def test_repeated_ids_give_a_datagram_each(spark):
    rng = random.Random(13)
    rows = []
    for key in range(25):
        t = 0.0
        for _ in range(60 if key == 2 else rng.randint(1, 6)):
            size = rng.randint(1, 60)
            cuts = sorted({0, size, *(rng.randrange(size) for _ in range(rng.randint(0, 4)))})
            frags = [(max(a - rng.choice([0, 0, 3]), 0), b) for a, b in zip(cuts, cuts[1:], strict=False)]
            frags += [rng.choice(frags)] if rng.random() < 0.2 else []
            rng.shuffle(frags)
            body = bytes(rng.randrange(256) for _ in range(size))
            for a, b in frags:
                t += rng.choice([0.01, 0.01, 0.01, 45.0 if rng.random() < 0.1 else 0.01])
                if rng.random() < 0.95:
                    rows.append((key, sipkit.at(round(t, 2)), a, b < size, body[a:b] if rng.random() < 0.9 else bytes(b - a)))
    rng.shuffle(rows)
    df = spark.createDataFrame([("c", "s", "d", k, 17, a, m, d, ts, len(d)) for k, ts, a, m, d in rows], schemas.FRAGMENTS)
    spark.conf.set("spark.sigspark.maxGroupRows", "50")
    try:
        whole, bad = reassembly.reassemble_fragments(df, ["capture_id", "src", "dst", "ip_id", "proto"])
        got = [(r.ip_id, r.ts, r.n_fragments, bytes(r.payload)) for r in whole.collect()] + [(r.ip_id, r.ts, r.n_fragments, None) for r in bad.collect()]
    finally:
        spark.conf.unset("spark.sigspark.maxGroupRows")
    assert sorted(got, key=repr) == in_order(rows)


def test_containers_within_containers(spark):
    from pyspark.sql import functions as F

    from sigspark.functions import sip

    cases = [
        ("multipart/mixed;boundary=b", "preamble\r\n--b\r\nContent-Type: a/b;\r\n boundary=no\r\n\r\nx\r\n\r\ny\r\n--b  \r\n\r\nbare\r\n--b--\r\nepilogue\r\n--b\r\nno\r\n"),
        ('multipart/mixed; boundary="q.+\\E("', "--q.+\\E(\nContent-Disposition: signal\n\n1\n--q.+\\E(x\n\n--q.+\\E(--"),
        ("multipart/a;boundary=1", "--1\nContent-Type: multipart/b;boundary=2\n\n--2\nContent-Type: multipart/c;boundary=3\n\n--3\nContent-Type: t/deep\n\nd\n--3--\n--2--\n--1\nContent-Type: t/last\n\nz"),
        ("text/plain", "--b\n"), (None, None), ("multipart/mixed", "--b\n\nx"), ("multipart/mixed;boundary=b", ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, b string")
    got = {r.i: [(p.path, p.part_type, p.disposition, p.body) for p in r.p] for r in df.select("i", sip.body_parts(F.col("b"), F.col("t")).alias("p")).collect()}
    assert got[0] == [("1", "a/b", "", "x\n\ny"), ("2", "", "", "bare")]
    assert got[1] == [("1", "", "signal", "1\n--q.+\\E(x\n")]
    assert got[2] == [("1.1.1", "t/deep", "", "d"), ("2", "t/last", "", "z")]
    assert got[3] == [("", "text/plain", "", "--b\n")] and got[4] == [("", "", "", "")] and got[5] == [("", "multipart/mixed", "", "--b\n\nx")] and got[6] == []
