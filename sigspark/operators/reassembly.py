"""Ordered reassembly of fragments and byte streams into messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.chains import lead_present, reached
from sigspark.plans.slices import Scanner, first_value, lag, lead, row_number, running_max, running_sum
from sigspark.session import stage
from sigspark.sources.textlog import is_start


class Datagram:
    """Fragments of one datagram, in order of arrival. Where parts overlap, the one with the larger offset counts, then the later one."""

    def __init__(self):
        self.parts: dict[int, bytes] = {}
        self.end = self.ts = None
        self.n = self.wire = 0

    def add(self, off: int, data: bytes, more: bool, ts, wire: int) -> None:
        self.n, self.wire = self.n + 1, self.wire + (wire or 0)
        self.ts = ts if self.ts is None else min(self.ts, ts)
        # a part that comes again replaces the beginning of the earlier one
        self.parts[off] = data + self.parts.get(off, b"")[len(data) :]
        if not more:
            self.end = off + len(data)

    def payload(self) -> bytes | None:
        """The bytes from 0 to the end, None while some are missing."""
        if self.end is None:
            return None
        reach, order = 0, sorted(self.parts)
        for off in order:
            if off > reach:
                break
            reach = max(reach, off + len(self.parts[off]))
        if reach < self.end:
            return None
        out = bytearray(max(self.end, 0))
        for off in order:
            part = self.parts[off][: max(self.end - off, 0)]
            out[off : off + len(part)] = part
        return bytes(out)


def reassemble_fragments(df: DataFrame, keys: Sequence[str], off: str = "off", data: str = "data", more: str = "more", timeout_s: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(datagrams, incomplete): fragments of a key put together in order of arrival.

    Ids repeat (16 bits), so a key is many datagrams one after the other: one ends as soon as it is complete, and whatever has come when
    no fragment follows for ``timeout_s`` is incomplete. Silences are found by a scan, so a key is spread over its busy times; within
    one, fragments stream through a sorted partition and the state is one datagram.
    """
    keys = list(keys)
    order = ["n"] if "n" in df.columns else ["ts", off]
    s = Scanner(df, keys, ["ts", *order[:1], off] if order == ["n"] else order).add(_before=lag(F.col("ts")))
    silent = F.coalesce(F.unix_micros("ts") - F.unix_micros("_before") > int(timeout_s * 1e6), F.lit(False))
    s.with_column("_silent", silent.cast("bigint")).add(_time=running_sum(F.col("_silent")))
    busy = [*keys, "_time"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ts timestamp, wire_bytes bigint, n_fragments bigint, size int, payload binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, Datagram()
        names = [*keys, "ts", "wire_bytes", "n_fragments", "size", "payload"]

        def told(whole):
            return (*key[:-1], held.ts, held.wire, held.n, held.end if whole is not None else None, whole)

        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in (*busy, off, data, more, "ts", "wire_bytes")]
            for *own, o, d, m, ts, wire in zip(*columns, strict=True):
                if own != key:
                    if held.n:
                        out.append(told(None))
                    key, held = own, Datagram()
                held.add(int(o), d or b"", bool(m), ts, wire)
                whole = held.payload()
                if whole is not None:
                    out.append(told(whole))
                    held = Datagram()
            yield pd.DataFrame(out, columns=names).astype({"size": "Int32"})
        if held.n:
            yield pd.DataFrame([told(None)], columns=names).astype({"size": "Int32"})

    cols = list(dict.fromkeys([*busy, *order, off, data, more, "ts", "wire_bytes"]))
    spread = s.df.select(*cols).repartition(*[F.col(k) for k in busy]).sortWithinPartitions(*busy, *order)
    told = stage(spread.mapInPandas(run, schema), "datagrams")
    bad = told.where(F.col("payload").isNull()).select(*keys, "ts", "n_fragments", F.lit("incomplete fragments").alias("warning"))
    return told.where(F.col("payload").isNotNull()), bad


def order_stream(df: DataFrame, flow: Sequence[str], seq: Column | None, n: str = "n", data: str = "payload") -> DataFrame:
    """Segments of each direction in stream order with their byte range: repeats dropped (first by
    arrival), sorted by sequence number where known, else by arrival."""
    flow = list(flow)
    base = df.where(F.octet_length(data) > 0).withColumn("_seq", seq if seq is not None else F.lit(None).cast("bigint"))
    known = base.where(F.col("_seq").isNotNull())
    rest = [c for c in base.columns if c not in [*flow, "_seq"]]
    first = known.groupBy(*flow, "_seq").agg(F.min_by(F.struct(*rest), n).alias("_row")).select(*flow, "_seq", "_row.*")
    once = first.unionByName(base.where(F.col("_seq").isNull()).select(*first.columns))
    s = Scanner(once, flow, ["_seq", n]).add(pos=row_number(), end_byte=running_sum(F.octet_length(data).cast("bigint")))
    return s.df.withColumn("start_byte", F.col("end_byte") - F.octet_length(data)).drop("_seq")


def text_length(buf: bytes) -> tuple[int, int]:
    """(skip, length) of the next text message: header end plus declared length; 0 length: not yet."""
    lead = len(buf) - len(buf.lstrip(b"\r\n"))
    end = buf.find(b"\r\n\r\n", lead)
    if end < 0:
        return lead, 0
    head = buf[lead:end].decode("latin-1").split("\r\n")
    first = head[0]
    if not (first.startswith("SIP/") or first.rstrip().split(" ")[-1].startswith("SIP/")):
        nxt = buf.find(b"\r\n", lead)
        return (nxt + 2 if nxt >= 0 else lead + 1), -1
    body = 0
    for line in head[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() in ("content-length", "l") and value.strip().isdigit():
            body = int(value.strip())
            break
    total = end + 4 - lead + body
    return lead, total if len(buf) - lead >= total else 0


def prefixed_length(buf: bytes) -> tuple[int, int]:
    """Two-byte length prefix, which is not part of the message."""
    if len(buf) < 2:
        return 0, 0
    size = int.from_bytes(buf[:2], "big")
    return 2, size if size and len(buf) >= 2 + size else 0


def diameter_length(buf: bytes) -> tuple[int, int]:
    """Version byte 1 and a three-byte length; anything else is skipped until one fits."""
    if len(buf) < 4:
        return 0, 0
    size = int.from_bytes(buf[1:4], "big")
    if buf[0] != 1 or size < 20 or size % 4:
        return 1, -1
    return 0, size if len(buf) >= size else 0


# Bytes of a line that are looked at; a longer line is neither a start line nor a header that is read.
LINE_BYTES = 65_536


def _stream_lines(segments: DataFrame, flow: list[str], data: str) -> DataFrame:
    """(flow, at, end, text): the lines of each stream with their byte range; a line may stretch over segments.

    Bytes are read as one character each. Lines within a segment stay where they are, only pieces at its ends are put together.
    """
    pieces = segments.select(*flow, "pos", F.split(F.decode(data, "ISO-8859-1"), "\n", -1).alias("_p"))
    rows = pieces.select(*flow, "pos", F.size("_p").alias("_k"), F.posexplode("_p").alias("_i", "text"))
    closed = F.col("_i") < F.col("_k") - 1
    rows = rows.withColumn("_closed", closed).withColumn("_bytes", F.length("text").cast("bigint") + closed.cast("bigint"))
    s = Scanner(rows, flow, ["pos", "_i"]).add(end=running_sum(F.col("_bytes")), _line=running_sum(F.col("_closed").cast("bigint"), inclusive=False))
    s.with_column("_line", F.coalesce("_line", F.lit(0))).with_column("at", F.col("end") - F.col("_bytes"))
    whole = (F.col("_i") > 0) & F.col("_closed")
    inner = s.df.where(whole).select(*flow, "at", "end", "text")
    edge = s.df.where(~whole)
    s = Scanner(edge, [*flow, "_line"], ["at", "_i", "pos"], known_max=s.most).add(_from=first_value(F.col("at")))
    # a body without line ends may be one very long line
    near = F.when(F.col("at") - F.col("_from") < LINE_BYTES, F.struct("at", "pos", "text"))
    joined = s.df.groupBy(*flow, "_line").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.sort_array(F.collect_list(near)).alias("_parts"))
    return inner.unionByName(joined.select(*flow, "at", "end", F.array_join(F.transform("_parts", lambda x: x["text"]), "").alias("text")))


def _text_pieces(segments: DataFrame, flow: list[str], data: str) -> DataFrame:
    """(flow, at, until, free): places where a text message may begin, and where it would end.

    A message begins with a line, or in the middle of one if the body before it ends exactly there. It goes to the first blank line and as many
    bytes further as its length header says. Without all of them it has no end.
    """
    lines = _stream_lines(segments, flow, data).withColumn("text", F.regexp_replace("text", "\r$", ""))
    could = F.col("text").rlike(r"SIP/\d{1,3}\.\d{1,3}(?:\s*$|\s+\d)")
    length = F.regexp_extract("text", r"(?i)^(?:content-length|l)\s*:\s*(\d{1,15})", 1)
    kept = stage(lines.where(could | (F.col("text") == "") | (length != "")).withColumn("_cl", length.try_cast("bigint")), "stream-lines")
    spots = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr("text", i, F.lit(1)).rlike("[A-Z]") & is_start(F.substr("text", i)))
    begins = kept.where(could).select(*flow, "at", F.explode(spots).alias("_i")).select(*flow, (F.col("at") + F.col("_i") - 1).alias("_spot"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_v"), (F.col("_i") == 1).alias("free"))
    blank = kept.where("text = ''").select(*flow, F.col("at").alias("_spot"), F.lit(1).alias("_kind"), F.col("end").alias("_v"), F.lit(False).alias("free"))
    told = kept.where(F.col("_cl").isNotNull()).select(*flow, F.col("at").alias("_spot"), F.lit(2).alias("_kind"), F.col("_cl").alias("_v"), F.lit(False).alias("free"))
    s = Scanner(begins.unionByName(blank).unionByName(told), flow, ["_spot", "_kind"])
    s.add(_gap=lead_present(F.when(F.col("_kind") == 1, F.struct("_spot", "_v"))), _length=lead_present(F.when(F.col("_kind") == 2, F.struct("_spot", "_v"))))
    body = F.when(F.col("_length._spot") < F.col("_gap._spot"), F.col("_length._v")).otherwise(0)
    size = segments.groupBy(*flow).agg(F.max("end_byte").alias("_size"))
    found = s.df.where("_kind = 0").withColumn("until", F.col("_gap._v") + body).join(size, flow)
    return found.select(*flow, F.col("_spot").alias("at"), F.when(F.col("until") <= F.col("_size"), F.col("until")).alias("until"), "free")


def _record_pieces(segments: DataFrame, flow: list[str], data: str) -> DataFrame:
    """(flow, at, until, free): places with the first bytes of a record, version 1 and a length of three bytes.

    After bytes that are none, only a record that is there in full is taken up; one that follows right on ends the stream if it is not.
    """
    head = F.substring(data, 1, 3)
    # the three bytes after a segment, however short the next ones are
    with_next = lambda c: F.substring(F.concat(F.col(data), F.coalesce(c, F.lit(b""))), 1, 3)
    s = Scanner(segments, flow, ["pos"]).add(_a1=lead(head))
    s.add(_a2=lead(with_next("_a1")))
    s.add(_a=lead(with_next("_a2")))
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in flow) + ", at bigint, until bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, until = [], [], []
            for i, (start, payload, ahead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start_byte", "_data", "_a")), strict=True)):
                b = np.frombuffer(payload + (ahead or b""), np.uint8)
                ones = np.nonzero(b[: min(len(payload), max(len(b) - 3, 0))] == 1)[0]
                size = (b[ones + 1].astype(np.int64) << 16) | (b[ones + 2].astype(np.int64) << 8) | b[ones + 3]
                ok = (size >= 20) & (size % 4 == 0)
                row.append(np.full(ok.sum(), i))
                at.append(start + ones[ok])
                until.append(start + ones[ok] + size[ok])
            if row and sum(map(len, row)):
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in flow), pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(until), pa.int64())], names=[*flow, "at", "until"])

    found = s.df.select(*flow, "start_byte", F.col(data).alias("_data"), "_a").mapInArrow(run, schema)
    size = segments.groupBy(*flow).agg(F.max("end_byte").alias("_size"))
    there = F.col("until") <= F.col("_size")
    return found.join(size, flow).select(*flow, "at", F.when(there, F.col("until")).alias("until"), there.alias("free"))


def frame_stream(segments: DataFrame, flow: Sequence[str], length_fn: Callable[[bytes], tuple[int, int]], ts: str = "ts", data: str = "payload") -> DataFrame:
    """Messages cut from ordered segments: (flow, msg_no, ts, payload, start_byte, end_byte).

    Text and record framing are set-based: every place where a message may begin is found with the place where it would
    end, and the real ones are those met by walking from end to end (``chains.reached``). Bytes that are no message cost nothing but their
    reading, and a stream of any size is spread. Other framings (``length_fn(buffer)`` gives bytes to skip and message length) are cut in order;
    a two-byte prefix bounds what is held. The first byte's segment gives the time; a partial end is dropped. ``segments`` is read several times.
    """
    flow = list(flow)
    pieces = {text_length: _text_pieces, diameter_length: _record_pieces}.get(length_fn)
    if pieces is None:
        return _cut_in_order(segments, flow, length_fn, ts, data)
    real = reached(stage(pieces(segments, flow, data), "stream-pieces"), flow, "at", "until", "free").where(F.col("until").isNotNull())
    numbered = Scanner(real.select(*flow, F.col("at").alias("start_byte"), F.col("until").alias("end_byte")), flow, ["start_byte"]).add(msg_no=row_number()).df
    messages = stage(numbered, "stream-messages")
    spans = message_segments(messages, segments, flow)
    parts = messages.join(spans, [*flow, "msg_no"]).withColumn("pos", F.explode(F.sequence("first_pos", "last_pos")))
    seg = segments.select(*flow, "pos", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"), F.col(ts).alias("_ts"), F.decode(data, "ISO-8859-1").alias("_text"))
    begin, end = F.greatest("start_byte", "_s"), F.least("end_byte", "_e")
    part = F.substr("_text", (begin - F.col("_s") + 1).cast("int"), (end - begin).cast("int"))
    whole = parts.join(seg, [*flow, "pos"]).groupBy(*flow, "msg_no").agg(
        F.min_by("_ts", "pos").alias(ts), F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))).alias("_parts"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")
    )
    payload = F.encode(F.array_join(F.transform("_parts", lambda x: x["t"]), ""), "ISO-8859-1")
    return whole.select(*flow, "msg_no", ts, payload.alias("payload"), "start_byte", "end_byte")


def _cut_in_order(segments: DataFrame, flow: list[str], length_fn, ts: str, data: str) -> DataFrame:
    """Framing by a function of the bytes at hand: a flow streams through a sorted partition, the state is its unframed end."""
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in flow) + f", msg_no bigint, `{ts}` {kinds[ts]}, payload binary, start_byte bigint, end_byte bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tail, at, no, marks = None, bytearray(), 0, 0, []
        for batch in batches:
            out = []
            for row in batch[[*flow, ts, data]].itertuples(index=False, name=None):
                if row[:-2] != key:
                    key, tail, at, no, marks = row[:-2], bytearray(), 0, 0, []
                marks.append((at + len(tail), row[-2]))
                tail += row[-1]
                while tail:
                    skip, size = length_fn(bytes(tail))
                    if skip == 0 and size == 0:
                        break
                    if size > 0:
                        start = at + skip
                        while len(marks) > 1 and marks[1][0] <= start:
                            marks.pop(0)
                        no += 1
                        out.append((*key, no, marks[0][1], bytes(tail[skip : skip + size]), start, start + size))
                    elif size == 0:
                        del tail[:skip]
                        at += skip
                        break
                    used = skip + max(size, 0)
                    del tail[:used]
                    at += used
            yield pd.DataFrame(out, columns=[*flow, "msg_no", ts, "payload", "start_byte", "end_byte"])

    ordered = segments.select(*flow, "pos", ts, data).repartition(*[F.col(c) for c in flow]).sortWithinPartitions(*flow, "pos")
    return ordered.mapInPandas(run, schema)


def message_segments(messages: DataFrame, segments: DataFrame, flow: Sequence[str]) -> DataFrame:
    """Which packets carried a message: the segment at its first byte up to the one at its last.

    Both sides are ordered by byte, so first and last segment are as-of lookups, not a range join.
    """
    flow = list(flow)
    seg = segments.select(*flow, F.col("start_byte").alias("b"), F.lit(0).alias("o"), F.col("pos").alias("pos"), F.lit(None).cast("bigint").alias("msg_no"))
    a = messages.select(*flow, F.col("start_byte").alias("b"), F.lit(1).alias("o"), F.lit(None).cast("bigint").alias("pos"), "msg_no")
    z = messages.select(*flow, (F.col("end_byte") - 1).alias("b"), F.lit(2).alias("o"), F.lit(None).cast("bigint").alias("pos"), "msg_no")
    s = Scanner(seg.unionByName(a).unionByName(z), flow, ["b", "o", "msg_no", "pos"]).add(_p=running_max(F.col("pos")))
    return s.df.where(F.col("o") > 0).groupBy(*flow, "msg_no").agg(F.min("_p").alias("first_pos"), F.max("_p").alias("last_pos"))
