"""Jaccard join of word-shingle sets by parity sketches.

A set is XOR-hashed into a bit sketch of wide parts: every shingle flips one bit of one part, and a part is kept as the XOR of
its set bits' positions. Two sketches differ in at most as many bits as the sets have elements in their symmetric
difference, which a Jaccard similarity of t limits to (1-t)/(1+t) of the summed sizes, d. So at most d parts differ, and of a set's non-zero parts at least (number - d) are found
equal in any partner: the pigeonhole join is one on equal non-zero parts. Of the parts that both sets have, the first k
in order are among the first d + k of each set, so that each sends no more than these and needs to share k. Sketches have as many parts as the size band
asks for; a set joins in its own band and, when a smaller partner may stand in the band below, there too.

1. Each task cuts its texts into sets, sketches them and sends the parts to buckets by hash, packed in binary blocks;
   a part that repeats within a task is sent once. Buckets give back the parts that at least two different sets have.
2. A set with fewer shared parts than it needs has no partner and is dropped. Of the others' parts, those that fewest sets have
   come first: without the last (needed - 1) of each set, two partners still meet in one part, while a passage that very many
   texts hold joins few of them.
3. Candidates are verified on the exact shingle sets. For all links (``links="all"``), sets that share such parts, directly or through others,
   are a family, and of each family every pair whose fine bit sketches are close enough is verified. For components alone
   (``links="joining"``), first each set with the one that stands for most of its parts is verified, in rounds; then, of sets that still share
   parts with another component, the close pairs; links that would join what is joined already are not looked for.
4. Components of the verified links: every task leaves a spanning forest of its links; what is left is joined in one task
   while counted to be small, else by label rounds that are each written to the shared folder.

Equal sets are one node throughout. Sets are compared as 64-bit hashes of shingles.

Cases: null text, empty text and text without words: no shingles, linked with nothing, own component; fewer than five
words: the whole text is one shingle; a null doc_id takes part in its component but names it only if all ids are null;
equal rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sigspark.llm import shingles
from sigspark.llm.common import WORKER_HELD, named_back, new_folder, partitions, set_aside, text_batches
from sigspark.session import BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT, int_conf, stage

U = np.uint64
PERCENT = 75
# A part is met by 48 bits of its hash: fewer bytes to send, and what is met by chance is verified like all else.
KEY_BITS = U(0xFFFFFFFFFFFF0000)
# Parts that a set needs to share, if it has as many beyond those that may differ: an 8th of its band's floor, but at least 8.
SHARE, LEAST_SHARE = 8, 8
# Parts collected by a task before they are sent on: 8 bytes each, and their set.
FLUSH = 500_000
# Steps in which the number of sets that have a part is told, four for every doubling.
LEVELS = 128
ROUNDS = 1
# Bits of the sketches that tell close pairs within a family, and sets of a family that a task compares with as many others.
FINE_BITS = 2_048
CHUNK_SETS = 4_096
# The same where all links are asked for: every pair of two chunks may be one.
ALL_CHUNK_SETS = 1_024
# Bytes of the compressed texts of a chunk, and of the exact sets that a task keeps while it compares.
CHUNK_BYTES = 24_000_000
# A family of more chunks than this is dealt by size, so that chunks whose sets are too far apart in size never meet.
PLAIN_CHUNKS = 3
KNOWN_BYTES = 64_000_000
# Links that a task turns into a spanning forest at once; a forest of no more is joined in one task.
FOREST_EDGES = 2_000_000

SIGNED = ["_node", "_n_shingles"]

BLOCK = "bucket int, kind int, data binary"
# Kinds of blocks: parts to be met with those of others; parts known to be shared; documents.
OPEN, MET, DOC = 0, 1, 2


def limit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of sets with a and b elements at a Jaccard similarity of percent/100."""
    return (100 - percent) * (a + b) // (100 + percent)


def parts(hashes: np.ndarray, sizes: np.ndarray, owners: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner of each key): the non-zero parts of sets in the bands that begin at ``floors``.

    ``hashes`` ascend within a set, so those of a part stand together.
    """
    # small bands have far more parts than elements, so that too few non-zero parts are out of the question
    count = np.where(floors < 16, 1 << 16, np.maximum(floors, 64)).astype(U)
    m, band = np.repeat(count, sizes), np.repeat(floors.astype(U), sizes)
    part = ((hashes >> U(32)) * m) >> U(32)
    new = np.ones(len(hashes), bool)
    new[1:] = (part[1:] != part[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(new)
    # the part's set bits, 2^64 places wide and nearly all zero, are kept as the XOR of their (mixed) positions
    bits = np.bitwise_xor.reduceat(shingles.mix(hashes), at)
    keys = shingles.mix(shingles.mix(bits + band[at] * U(0x9E3779B97F4A7C15)) + part[at])
    return keys & KEY_BITS, owners[at]


def bands(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several sets: keys, the number of each key's set, and how many parts that set needs to share in the key's band.

    A set's parts are in the order of their places, which is the same for all sets of a band: enough of the first ones are kept.
    """
    n = np.diff(bounds)
    floor = 1 << (np.frexp(np.maximum(n, 1))[1] - 1)
    out = []
    for role in ("own", "below"):
        if role == "own":
            at = floor
            most = limit(n, n * 100 // percent, percent)
            use = (n > 0) & (most > 0)
        else:
            at = floor // 2
            least = -(-n * percent // 100)
            most = limit(n, np.minimum(n, floor - 1), percent)
            use = (n > 0) & (least < floor) & (most > 0)
        chosen = np.flatnonzero(use)
        if not len(chosen):
            continue
        size = n[chosen]
        take = np.repeat(bounds[chosen] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        keys, owner = parts(hashes[take], size, np.repeat(np.arange(len(chosen)), size), at[chosen])
        count = np.bincount(owner, minlength=len(chosen))
        share = np.maximum(at[chosen] // SHARE, LEAST_SHARE)
        need = np.minimum(count - most[chosen], share)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) < (most[chosen] + share)[owner]
        keys, owner = keys[first], owner[first]
        out.append((keys, chosen[owner], need[owner]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(keys: np.ndarray, nodes: np.ndarray, needs: np.ndarray) -> bytes:
    """Parts of sets in one block: keys ascending as differences, each set once with its need, ascending likewise."""
    order = np.argsort(keys, kind="stable")
    keys, nodes, needs = keys[order], nodes[order], needs[order]
    by_set = np.lexsort((needs, nodes))
    new = np.ones(len(keys), bool)
    new[1:] = (nodes[by_set][1:] != nodes[by_set][:-1]) | (needs[by_set][1:] != needs[by_set][:-1])
    at = np.empty(len(keys), np.uint32)
    at[by_set] = np.cumsum(new) - 1
    first = by_set[new]
    steps, sets = (np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T for x in (keys, nodes[first]))
    places = at.view(np.uint8).reshape(-1, 4).T
    own = [sets.tobytes(), needs[first].astype(np.int32).tobytes()]
    raw = b"".join([np.array([len(keys), len(first)], U).tobytes(), steps.tobytes(), places.tobytes(), *own])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    """keys, nodes, needs of a block."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = (int(x) for x in np.frombuffer(raw, U, 2))
    ascending = lambda k, at: np.cumsum(np.frombuffer(raw, np.uint8, 8 * k, at).reshape(8, k).T.copy().view(U).ravel(), dtype=U)
    places = np.frombuffer(raw, np.uint8, 4 * n, 16 + 8 * n).reshape(4, n).T.copy().view(np.uint32).ravel()
    at = 16 + 12 * n
    return [ascending(n, 16), ascending(m, at)[places], np.frombuffer(raw, np.int32, m, at + 8 * m)[places]]


def _batch(bucket: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"])


def _place(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x >> U(40)) % U(buckets)


def _deal(kind: int, by: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the columns, dealt to buckets by the numbers ``by``."""
    to = _place(by, buckets).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.cumsum(np.bincount(to, minlength=buckets))
    for b, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if end > start:
            yield _batch(b, kind, pack(*(c[order[start:end]] for c in columns)))


def _gather(batches: Iterator[pa.RecordBatch], kind: int) -> tuple[list[np.ndarray] | None, list[bytes]]:
    """All blocks of a kind together, each set once per key; and the data of other blocks."""
    blocks, rest = [], []
    for batch in batches:
        for k, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if k == kind:
                blocks.append(unpack(data))
            else:
                rest.append((k, data))
    if not blocks:
        return None, rest
    columns = [np.concatenate(x) for x in zip(*blocks, strict=True)]
    blocks.clear()
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return [c[fresh] for c in columns], rest


def _tally(nodes: np.ndarray, reps: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(reps, nodes, sums): times summed up per node and rep."""
    order = np.lexsort((reps, nodes))
    nodes, reps, times = nodes[order], reps[order], times[order]
    new = np.ones(len(nodes), bool)
    new[1:] = (nodes[1:] != nodes[:-1]) | (reps[1:] != reps[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(times, at) if len(at) else times
    return reps[at], nodes[at], sums


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry is the first of its key, entries of each key) of ascending keys."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return first, np.diff(np.append(np.flatnonzero(first), len(keys)))


def sketch(docs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The blocks that tasks send to buckets: parts by their key, documents anywhere."""

    def flush(keys: list, nodes: list, needs: list) -> Iterator[pa.RecordBatch]:
        columns = []
        for x in (keys, nodes, needs):
            columns.append(np.concatenate(x))
            x.clear()
        order = np.lexsort((columns[1], columns[0]))
        k, n, g = (columns.pop(0)[order] for _ in range(3))
        del order
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        k, n, g = k[fresh], n[fresh], g[fresh]
        first, runs = _runs(k)
        # the first set of each part stands for the task; parts met here are settled and only stand for others to meet
        yield from _deal(OPEN, k[first], buckets, k[first], n[first], g[first])
        met = np.repeat(runs > 1, runs)
        if met.any():
            yield from _deal(MET, n[met], buckets, k[met], n[met], g[met])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WORKER_HELD.clear()
        keys, nodes, needs, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0)
            for first, texts in shingles.pieces(batch.column(1)):
                hashes, bounds = shingles.sets(texts)
                node = shingles.signature(hashes, bounds)
                k, owner, need = bands(hashes, bounds, percent)
                keys.append(k)
                nodes.append(node[owner])
                needs.append(need.astype(np.int32))
                held += len(k)
                part = ids.slice(first, len(texts))
                known = np.array(part.is_valid().to_pylist())
                value = np.array(part.fill_null(0).to_pylist(), np.int64).view(U)
                # a document's entry: id, node, number of shingles (minus one more for a null id)
                size = np.where(known, np.diff(bounds), -1 - np.diff(bounds))
                yield _batch(int(node[0] % U(buckets)), DOC, pack(value, node, size.astype(np.int32)))
                if held >= FLUSH:
                    yield from flush(keys, nodes, needs)
                    held = 0
        if held:
            yield from flush(keys, nodes, needs)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text_batches(docs.sparkSession)
    return rows.mapInArrow(run, BLOCK)


def meet(buckets: int):
    """Of a bucket's blocks: parts that two different sets have, with each such set, dealt by the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = _gather(batches, OPEN)
        for kind, data in rest:
            to = 0 if kind == DOC else int(_place(unpack(data)[1][:1], buckets)[0])  # a block of met parts is of one bucket
            yield _batch(to, kind, data)
        if found is not None:
            k, n, g = found
            _, runs = _runs(k)
            shared = np.repeat(runs > 1, runs)
            if shared.any():
                yield from _deal(MET, n[shared], buckets, k[shared], n[shared], g[shared])

    return run


def count(buckets: int):
    """Of a bucket of sets: the parts of those that share as many parts of a band as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = _gather(batches, MET)
        for kind, data in rest:
            yield _batch(0, kind, data)
        if found is not None:
            k, n, g = found
            # a set has one need per band; where two bands have the same, counting both keeps more
            order = np.lexsort((g, n))
            k, n, g = k[order], n[order], g[order]
            same = np.ones(len(n), bool)
            same[1:] = (n[1:] != n[:-1]) | (g[1:] != g[:-1])
            runs = np.diff(np.append(np.flatnonzero(same), len(n)))
            alive = np.repeat(runs, runs) >= g
            if alive.any():
                yield from _deal(MET, n[alive], buckets, k[alive], n[alive], g[alive])

    return run


def documents(stored: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles from the blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, node, size = unpack(data)
                known = size >= 0
                ids = pa.array(ids.view(np.int64), mask=~known)
                n = np.where(known, size, -1 - size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(node.view(np.int64)), pa.array(n)], ["doc_id", "node", "n_shingles"])

    return stored.where(F.col("kind") == DOC).select("data").mapInArrow(run, "doc_id long, node long, n_shingles long")


def stars(alive: DataFrame, buckets: int) -> DataFrame:
    """a, b, n: sets a with the set b that stands for n of their parts (the smallest node that has the part).

    Partners share at least as many parts as each of them needs. So in one order of all parts, those that fewest sets have
    first, the first one that two partners share is not among the last (needed - 1) of either: these are left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                k, n, g = unpack(data)
                yield from _deal(OPEN, k, buckets, k, n, g)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = _gather(batches, OPEN)
        if found is not None:
            k, n, g = found
            _, runs = _runs(k)
            level = np.repeat(np.minimum(4 * np.log2(runs), LEVELS - 1).astype(np.int32), runs)
            met = np.repeat(runs > 1, runs)
            yield from _deal(OPEN, n[met], buckets, k[met], n[met], g[met] * np.int32(LEVELS) + level[met])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = _gather(batches, OPEN)
        if found is not None:
            k, n, told = found
            need, level = told // LEVELS, told % LEVELS
            order = np.lexsort((k, level, need, n))
            k, n, need = k[order], n[order], need[order]
            # a set's parts of a band: those of one need, as where they were counted
            new = np.ones(len(n), bool)
            new[1:] = (n[1:] != n[:-1]) | (need[1:] != need[:-1])
            start = np.flatnonzero(new)
            runs = np.diff(np.append(start, len(n)))
            first = np.arange(len(n)) - np.repeat(start, runs) <= np.repeat(runs, runs) - need
            yield from _deal(OPEN, k[first], buckets, k[first], n[first], need[first])

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = _gather(batches, OPEN)
        if found is not None:
            k, n, _ = found
            first, runs = _runs(k)
            rep = np.repeat(n[first], runs)  # nodes ascend within a key
            other = n != rep
            b, a, times = _tally(n[other], rep[other], np.ones(int(other.sum()), np.int64))
            yield from _deal(OPEN, a, buckets, b, a, times)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [unpack(data) for batch in batches for data in batch.column("data").to_pylist()]
        if blocks:
            rep, node, times = (np.concatenate(x) for x in zip(*blocks, strict=True))
            b, a, n = _tally(node, rep, times.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    by_key = alive.select("data").mapInArrow(send, BLOCK).repartition(buckets, "bucket")
    by_set = by_key.mapInArrow(weigh, BLOCK).repartition(buckets, "bucket")
    by_key = by_set.mapInArrow(rarest, BLOCK).repartition(buckets, "bucket")
    by_set = by_key.mapInArrow(meet_again, BLOCK).repartition(buckets, "bucket")
    return by_set.mapInArrow(tally, "a long, b long, n long")


def crossing(stars_: DataFrame, label: DataFrame) -> DataFrame:
    """The stars whose two sets lie in different components."""
    one = stars_.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    return one.join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca != cb").select("a", "b", "n")


def best(pairs: DataFrame) -> DataFrame:
    """Each set with the one that stands for most of its parts."""
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def families(stars_: DataFrame, label: DataFrame) -> DataFrame:
    """node, comp, family: sets around a centre whose star crosses components; two that share a part are of one family."""
    centres = crossing(stars_, label).select("b").distinct()
    around = stage(stars_.join(centres, "b", "left_semi").select("a", "b"), "around")
    nodes = around.select(F.col("a").alias("node")).union(around.select("b")).distinct()
    return label.join(components(around, nodes).select("node", F.col("comp").alias("family")), "node")


def close_links(members: DataFrame, texts: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """a, b, both: links that join the components within each family, or (``every``) all links within each family.

    A family is dealt into chunks (``dealt``) and every two chunks whose sets may be alike in size meet in one task. There, fine bit sketches tell the pairs that may be
    similar enough, those of different components are verified on the exact sets, and a link joins its components: what comes
    back is at most one link for each set of the two chunks. With ``every``, all of these pairs are verified and links join nothing.
    """
    chunk_sets = ALL_CHUNK_SETS if every else CHUNK_SETS

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for _, some in shingles.chunks([tool.decompress(d).decode("utf-8", "surrogatepass") for d in batch.column("data").to_pylist()]):
                hashes, bounds = shingles.sets(some)
                owner = np.repeat(np.arange(len(some)), np.diff(bounds))
                bits = np.zeros((len(some), FINE_BITS // 64), U)
                place = shingles.mix(hashes ^ U(0x5851F42D4C957F2D)) % U(FINE_BITS)
                np.bitwise_xor.at(bits, (owner, (place >> U(6)).astype(np.int64)), U(1) << (place & U(63)))
                out += [b.tobytes() for b in bits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bits"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("node", "ascending")])
        node, n, mine = (table[c].to_numpy() for c in ("node", "n", "place"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), U).reshape(len(table), -1)
        data, tool = table["data"].to_pylist(), zstandard.ZstdDecompressor()
        two = table["lo"][0].as_py() != table["hi"][0].as_py()
        _, group = np.unique(table["comp"].to_numpy(), return_inverse=True)
        # rows of each group, so that joining two relabels the smaller one
        rows = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        known: dict[int, np.ndarray] = {}
        held = 0

        def exact(i: int) -> np.ndarray:
            nonlocal held
            if i not in known:
                one = shingles.sets([tool.decompress(data[i])])[0]
                if held + one.nbytes > KNOWN_BYTES:
                    # cut again when asked for again
                    known.clear()
                    held = 0
                known[i], held = one, held + one.nbytes
            return known[i]

        out = []
        # sets ascend in size: partners of i are those after it up to its largest size
        last = np.searchsorted(n, n * 100 // percent, side="right")
        for i in range(len(table)):
            to = slice(i + 1, int(last[i]))
            far = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = far <= limit(n[to], n[i], percent)
            if not every:
                near &= group[to] != group[i]
            if two:
                near &= mine[to] != mine[i]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if not every and group[i] == group[j]:
                    continue
                both = len(np.intersect1d(exact(i), exact(j), assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    out.append((int(node[i]), int(node[j]), both))
                    if every:
                        continue
                    small, large = sorted((group[i], group[j]), key=lambda g: len(rows[g]))
                    group[rows[small]] = large
                    rows[large] = np.concatenate((rows[large], rows[small]))
        a, b, both = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array(both, pa.int64())})

    # a chunk's place and the places that it meets are found without the texts, which are then dealt by node and by place alone
    placed = dealt(members.join(texts.select("node", "n", "bytes"), "node"), percent, chunk_sets)
    whole = texts.select("node", "data").join(placed, "node").select("node", "n", "comp", "family", "place", "others", "data")
    text_batches(texts.sparkSession)
    sketched = whole.mapInArrow(fine, StructType([*whole.schema.fields, StructField("bits", BinaryType())]))
    met = sketched.withColumn("other", F.explode("others"))
    met = met.select("family", F.least("place", "other").alias("lo"), F.greatest("place", "other").alias("hi"), "place", "node", "comp", "n", "bits", "data")
    return met.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long, both long")


def dealt(members: DataFrame, percent: int, chunk_sets: int) -> DataFrame:
    """``members`` (node, comp, family, n, bytes) with place, the chunk of their family, and others, the places it meets.

    Chunks have a bounded number of sets and bytes. Of a family of few chunks all meet. A larger one is dealt into bands of
    sizes first, as wide as partners may differ: a chunk meets those of its own band and of the two next to it.
    """
    members = stage(members, "weighed")
    enough = F.greatest(F.ceil(F.count(F.lit(1)) / chunk_sets), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int")
    # families of several chunks are few: each has more sets or bytes than a chunk
    large = F.broadcast(members.groupBy("family").agg(enough.alias("whole")).where("whole > 1"))
    # a little wider, so that rounding never puts partners two bands apart
    width = 1.0001 * max(math.log(100 / percent), 0.001)
    band = F.when(F.col("whole") > PLAIN_CHUNKS, F.floor(F.log("n") / width)).otherwise(0).cast("long")
    banded = members.join(large, "family", "left").withColumn("band", band)
    chunks = stage(banded.where("whole > 1").groupBy("family", "band").agg(enough.alias("chunks")), "chunks")
    near = chunks.select("family", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"), F.struct("band", "chunks").alias("near"))
    seen = chunks.join(near.groupBy("family", "band").agg(F.collect_list("near").alias("near")), ["family", "band"])
    place = lambda band, chunk: band * F.lit(1 << 32) + chunk
    others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["chunks"] - 1), lambda i: place(x["band"], i))))
    own = place(F.col("band"), F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
    out = banded.join(F.broadcast(seen), ["family", "band"], "left").withColumn("place", own)
    return out.withColumn("others", F.coalesce(others, F.array("place"))).select(*members.columns, "place", "others")


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, n, bytes, data (compressed text) of one document for each node; ``members`` has doc_id, node and n.

    Texts are fetched by doc_id; an id that repeats with another text, or is null, is told apart by the signature. What is
    fetched is written; rows that repeat fall together where texts are joined by node, for which they are dealt once.
    """
    spark = docs.sparkSession
    members = stage(members, "members")
    if members.count() <= int_conf(spark, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT):
        members = F.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            wanted, n = (batch.column(c).to_pylist() for c in (0, 2))
            for first, texts in shingles.pieces(batch.column(1)):
                node = shingles.signature(*shingles.sets(texts)).view(np.int64).tolist()
                kept = [i for i, x in enumerate(node) if wanted[first + i] is None or wanted[first + i] == x]
                if kept:
                    data = [tool.compress(texts[i]) for i in kept]
                    numbers = [[node[i] for i in kept], [n[first + i] for i in kept], [len(d) for d in data]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(data, pa.binary())], ["node", "n", "bytes", "data"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "node long, n long, bytes long, data binary"
    named = rows.join(members.where("doc_id IS NOT NULL"), "doc_id").select("node", "text", F.col("n").cast("long")).mapInArrow(run, kind)
    unnamed = rows.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), "text", F.lit(None).cast("long").alias("n")).mapInArrow(run, kind)
    unnamed = unnamed.drop("n").join(members.where("doc_id IS NULL").select("node", F.col("n").cast("long")), "node").select("node", "n", "bytes", "data")
    fetched = stage(named.union(unnamed), "texts")
    return fetched.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bytes", "data")))


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b, both: the pairs that are similar enough, with the size of their intersection, on the exact sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                a, b, x, y = (c.to_pylist() for c in batch.slice(at, 500).columns)
                data = {d: i for i, d in enumerate(dict.fromkeys([*x, *y]))}
                held = [(h, bounds) for _, some in shingles.chunks([tool.decompress(d).decode("utf-8", "surrogatepass") for d in data]) for h, bounds in [shingles.sets(some)]]
                sets = [h[bounds[i] : bounds[i + 1]] for h, bounds in held for i in range(len(bounds) - 1)]
                kept = []
                for left, right, one, two in zip(a, b, x, y, strict=True):
                    s, t = sets[data[one]], sets[data[two]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        kept.append((left, right, both))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["a", "b", "both"])

    sizes = texts.select("node", "n")
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    near = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    left = near.join(texts.select(F.col("node").alias("a"), F.col("data").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each can reach by the links a-b, but for the smallest ones themselves."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(len(ids)))
            return ids[moved], ids[label[moved]]
        label = new


def forest(links: DataFrame, edges: int) -> DataFrame:
    """a, b: links with the same components, of every ``edges`` links of a task one for each node but the smallest of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= edges:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    def cut(held):
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(a, b)], ["a", "b"])

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable by ``links`` (a, b), for all ``nodes``, in a written table.

    Every task leaves a spanning forest of its links. Forests counted to be small are joined in one task; larger ones in label
    rounds, each written.
    """
    trees = stage(forest(links, FOREST_EDGES), "forest")
    if trees.count() <= FOREST_EDGES:
        low = forest(trees.coalesce(1), FOREST_EDGES).select(F.col("a").alias("node"), F.col("b").alias("low"))
        return stage(nodes.select("node").join(low, "node", "left").select("node", F.coalesce("low", "node").alias("comp")), "labels")
    return label_rounds(trees, nodes)


def label_rounds(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``components`` for any number of links; every round is written."""
    label = stage(nodes.select("node", F.col("node").alias("comp")), "labels")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        moved = label.join(near.withColumnRenamed("a", "node"), "node", "left").withColumn("low", F.least("comp", F.coalesce("near", "comp")))
        # the old component's own label moves with its members, and labels are followed one step: distances halve
        hook = moved.groupBy("comp").agg(F.min("low").alias("hook"))
        hooked = moved.join(hook, "comp").select("node", F.least("low", "hook").alias("to"), F.col("comp").alias("was"))
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("top"))
        new = stage(hooked.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("comp"), "was"), "labels")
        if not new.where("comp != was").limit(1).count():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def join(docs: DataFrame, percent: int = PERCENT, links: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, node, n_shingles; links between nodes: a, b, both; node, comp of nodes that may have links).

    A node stands for all documents with equal sets. ``links="all"`` has every two similar nodes once; ``links="joining"``
    only enough of them to join the components.
    """
    if links not in ("all", "joining"):
        raise ValueError(f"links must be 'all' or 'joining', not {links!r}")
    spark: SparkSession = docs.sparkSession
    buckets = partitions(spark)
    by_key = sketch(docs, percent, buckets).repartition(buckets, "bucket").mapInArrow(meet(buckets), BLOCK)
    by_set = by_key.repartition(buckets, "bucket").mapInArrow(count(buckets), BLOCK)
    folder = new_folder(spark, "sketches")
    by_set.write.partitionBy("kind").parquet(folder)
    stored = spark.read.schema(BLOCK).parquet(folder)
    members, alive = documents(stored), stored.where(F.col("kind") == MET)
    star = stage(stars(alive, buckets), "stars")
    nodes = stage(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), "nodes")
    one = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    texts = texts_of(docs, one)
    if links == "all":
        # similar sets share a part, and all sets with a part share it with the one that stands for it
        family = components(star, nodes).select("node", F.col("node").alias("comp"), F.col("comp").alias("family"))
        found = stage(close_links(family, texts, percent, every=True), "links")
        return members, found, components(found, nodes)
    found = stage(verify(best(star), texts, percent), "links")
    label = components(found, nodes)
    for _ in range(ROUNDS):
        found = found.union(stage(verify(best(crossing(star, label)), texts, percent), "links"))
        label = components(found, nodes)
    rest = stage(families(star, label), "families")
    found = found.union(stage(close_links(rest, texts, percent), "links"))
    return members, found, components(found, nodes)


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, node, n_shingles, comp (null without words) for every row of ``docs``."""
    members, _, label = join(docs, percent, links="joining")
    return members.join(label, "node", "left").withColumn("comp", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")))


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs``."""
    rows = _labelled(docs, percent)
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("low"))
    out = rows.join(least, "comp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def signed(docs: DataFrame) -> DataFrame:
    """``docs`` with node (the signature of the text's set) and n_shingles; clashing names are not looked for."""
    at = docs.columns.index("text")
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, texts in shingles.pieces(batch.column(at)):
                hashes, bounds = shingles.sets(texts)
                node.append(shingles.signature(hashes, bounds).view(np.int64))
                n.append(np.diff(bounds).astype(np.int64))
            own = [pa.array(np.concatenate(node), pa.int64()), pa.array(np.concatenate(n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *SIGNED])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in SIGNED)]))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; documents without words stay.

    A document is told by its doc_id and its set: repeated rows are one, an id that stands for several texts may keep
    several. A null doc_id comes after all others; rows without id and without words all stay.
    """
    rows = stage(_labelled(docs, percent), "labelled")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    best_ = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(rank).alias("least")).select("least.doc_id", "least.node")
    kept = best_.union(rows.where("comp IS NULL AND doc_id IS NOT NULL").select("doc_id", "node").distinct())
    kept = stage(kept.select(F.col("doc_id").alias("_kept"), F.col("node").alias("_kept_node")), "kept")
    # only where the id alone does not tell, the texts are signed again
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    several = stage(several.select(F.col("doc_id").alias("_several")), "several")
    aside = set_aside(docs, SIGNED)
    long_id = aside["doc_id"].cast("long")
    plain = aside.where(long_id.isNotNull()).join(several, long_id == several["_several"], "left_anti").dropDuplicates(["doc_id"])
    plain = plain.join(kept, plain["doc_id"].cast("long") == kept["_kept"], "left_semi")
    unclear = signed(aside.where(long_id.isNull()).unionByName(aside.join(several, long_id == several["_several"], "left_semi")))
    same = unclear["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (unclear["_node"] == kept["_kept_node"])
    told = unclear.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_node"])
    bare = unclear.where(unclear["doc_id"].cast("long").isNull() & (unclear["_n_shingles"] == 0))
    return named_back(plain.unionByName(told.unionByName(bare).drop(*SIGNED)), docs, SIGNED)
