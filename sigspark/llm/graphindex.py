"""Nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are normalised in double precision and equal ones are merged into one node that keeps its k+1 smallest ids (no
search for k others can want more). Nodes are dealt to shards by a hash of the vector; a shard holds at most
about ``shard_nodes``, and more data mean more shards. Queries are dealt to blocks of about ``block_queries``. A shard's graph is built
once and stored as a table of edges; each block of queries meets it in a task of its own, which gives back ids alone. So a task holds
one shard and one block, however many vectors and queries there are. Within a shard:

* build: nodes are put in by doubling rounds. A beam search over the graph so far proposes neighbours; robust pruning keeps
  a proposal unless a kept, nearer one is closer to it by the factor alpha; edges are added both ways and pruned again.
* search: the queries of a block walk the graph together by beam search from the medoid; each shard gives its best ``k``.

The shards' best are merged by exact cosine of the original vectors, computed as one formula everywhere.

Cases: vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite components
take no part, as query or as candidate; null ids take no part; repeated rows (same id and vector) are one candidate; a
query's own id is never its result; fewer than k candidates: all of them; ties go to the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.plans.slices import top_per
from sigspark.session import stage

SHARD_NODES = 8_192
DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM = 32, 1.2, 48, 96
# Edges that a node may collect from later nodes before they are pruned to the degree again.
SLACK = 16
SEED = 11
# Queries that walk a shard's graph together, and queries that a task answers.
TOGETHER = 512
BLOCK_QUERIES = 4_096


def usable(v: Column) -> Column:
    """Whether the vector has only finite components and is not zero."""
    d = v.cast("array<double>")
    sound = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & sound & F.exists(d, lambda x: x != 0)


def prune(points: np.ndarray, at: int, found: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: of ``found`` (with squared distances ``near`` to point ``at``), at most ``degree`` diverse ones."""
    order = np.lexsort((found, near))
    found, near = found[order], near[order]
    found, near = found[found != at], near[found != at]
    vectors = points[found]
    apart = np.maximum(2.0 - 2.0 * (vectors @ vectors.T), 0.0)
    kept, open_ = [], np.ones(len(found), bool)
    for i in range(len(found)):
        if open_[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            open_ &= alpha * apart[i] > near
    return found[kept]


class Graph:
    """A directed graph over unit vectors with at most ``degree`` edges a node (and a few yet to be pruned)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = SEED):
        self.points, self.degree, self.alpha = points.astype(np.float32), degree, alpha
        n = len(points)
        self.edges = np.full((n, degree + SLACK), -1, np.int32)
        mean = self.points.mean(0)
        self.entry = int((self.points @ mean).argmax())
        order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
        order = np.concatenate(([self.entry], order[order != self.entry]))
        # rounds of growing size: each searches the graph that the earlier ones made, and its own members among each other
        start = 1
        while start < n:
            end = min(n, start + max(1, min(start, 1_024)))
            self._insert(order[start:end], order[:end] if end - start >= start or end <= 256 else None, beam)
            start = end
        self._insert(order, None, beam)  # once more over the whole, so that early nodes see late ones

    @classmethod
    def stored(cls, points: np.ndarray, edges: np.ndarray, entry: int) -> Graph:
        """A graph that was built before."""
        out = cls.__new__(cls)
        out.points, out.edges, out.entry = points.astype(np.float32), edges, entry
        return out

    def _insert(self, nodes: np.ndarray, small: np.ndarray | None, beam: int) -> None:
        for at in range(0, len(nodes), TOGETHER):
            some = nodes[at : at + TOGETHER]
            if small is not None and len(small) <= 512:
                found = np.broadcast_to(small, (len(some), len(small)))
            else:
                found, _ = self.search(self.points[some], beam)
                # members of a batch don't see each other in the graph: propose the nearest of them as well
                peers = self.points[some] @ self.points[some].T
                k = min(len(some), self.degree // 2)
                found = np.hstack([found, some[np.argpartition(-peers, k - 1, axis=1)[:, :k]], self.edges[some]])
            back: dict[int, list[int]] = {}
            for node, row in zip(some.tolist(), found, strict=True):
                row = np.unique(row[row >= 0])
                near = np.maximum(2.0 - 2.0 * (self.points[row] @ self.points[node]), 0.0)
                kept = prune(self.points, node, row, near, self.degree, self.alpha)
                self.edges[node] = -1
                self.edges[node, : len(kept)] = kept
                for other in kept.tolist():
                    back.setdefault(other, []).append(node)
            for node, new in back.items():
                own = self.edges[node]
                row = np.unique(np.concatenate((own[own >= 0], new)))
                if len(row) > self.degree + SLACK:
                    near = np.maximum(2.0 - 2.0 * (self.points[row] @ self.points[node]), 0.0)
                    row = prune(self.points, node, row, near, self.degree, self.alpha)
                self.edges[node] = -1
                self.edges[node, : len(row)] = row

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes met by each query (-1 where fewer), and their cosines; all queries step together."""
        q, n = queries.astype(np.float32), len(self.points)
        rows = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.entry, q @ self.points[self.entry], False
        seen[:, self.entry] = True
        active = rows
        while len(active):
            # the nearest few nodes of each beam whose edges were not followed yet
            ahead = np.where(done[active], -np.inf, sims[active])
            width = min(4, beam)
            pick = np.argpartition(-ahead, width - 1, axis=1)[:, :width]
            ready = np.take_along_axis(ahead, pick, 1) > -np.inf
            has = ready.any(1)
            active, pick, ready = active[has], pick[has], ready[has]
            if not len(active):
                break
            done[active[:, None], pick] = True
            at = np.where(ready, ids[active[:, None], pick], -1)
            next_ = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(active), -1)
            fresh = (next_ >= 0) & ~seen[active[:, None], next_]
            owner, place = np.nonzero(fresh)
            target = next_[owner, place]
            key = np.unique(owner * np.int64(n) + target)  # two edges may lead to one node
            owner, target = key // n, key % n
            seen[active[owner], target] = True
            value = np.einsum("ij,ij->i", q[active[owner]], self.points[target])
            slot = np.arange(len(owner)) - np.searchsorted(owner, owner)
            most = int(slot.max()) + 1 if len(slot) else 0
            new_ids = np.full((len(active), most), -1, np.int64)
            new_sims = np.full((len(active), most), -np.inf, np.float32)
            new_ids[owner, slot], new_sims[owner, slot] = target, value
            all_ids, all_sims = np.hstack([ids[active], new_ids]), np.hstack([sims[active], new_sims])
            all_done = np.hstack([done[active], new_ids < 0])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length."""
    return table[name].combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _unit(points: np.ndarray) -> np.ndarray:
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def build(table: pa.Table) -> pa.Table:
    """Of a shard's nodes (shard, h, v): the same with their places in the graph, their edges, and whether the search starts there."""
    table = table.select(["shard", "h", "v"]).sort_by([("h", "ascending")])
    graph = Graph(_unit(_matrix(table, "v")))
    ends = np.arange(len(table) + 1, dtype=np.int32) * graph.edges.shape[1]
    edges = pa.ListArray.from_arrays(pa.array(ends), pa.array(graph.edges.ravel()))
    place = np.arange(len(table), dtype=np.int32)
    return table.append_column("place", pa.array(place)).append_column("edges", edges).append_column("entry", pa.array(place == graph.entry))


def answer(nodes: pa.Table, asked: pa.Table, k: int, beam: int) -> pa.Table:
    """query_id, h: the ``k`` best nodes of a stored shard for each query of a block, and those that rounding may have put level."""
    query_ids, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(nodes) and len(asked):
        nodes = nodes.sort_by([("place", "ascending")])
        unit, h = _unit(_matrix(nodes, "v")), nodes["h"].to_numpy()
        graph = Graph.stored(unit, _matrix(nodes, "edges"), int(np.flatnonzero(nodes["entry"].to_numpy(zero_copy_only=False))[0]))
        ids, q = asked["query_id"].to_numpy(), _unit(_matrix(asked, "q"))
        for at in range(0, len(q), TOGETHER):
            found, _ = graph.search(q[at : at + TOGETHER], beam)
            for query_id, vector, row in zip(ids[at : at + TOGETHER], q[at : at + TOGETHER], found, strict=True):
                row = row[row >= 0]
                score = unit[row] @ vector
                most = min(len(score), k + 1)
                best = row[score >= np.partition(score, -most)[-most] - 1e-12]
                query_ids.append(np.full(len(best), query_id))
                hits.append(h[best])
    return pa.table({"query_id": pa.array(np.concatenate(query_ids), pa.int64()), "h": pa.array(np.concatenate(hits), pa.int64())})


def blocks(queries: DataFrame, n_queries: int, shards: int, block_queries: int) -> DataFrame:
    """The queries (query_id, q) for each shard, with shard and block."""
    n = max(1, -(-n_queries // block_queries))
    block = F.pmod(F.xxhash64("query_id", "q"), F.lit(n)).cast("int")
    return queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard_nodes: int = SHARD_NODES, search_beam: int = SEARCH_BEAM, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common["n"])
    # equal vectors are one node; the k+1 smallest ids of a node are all that k results can hold besides the query itself
    member = top_per(rows.select("v", "id").distinct().withColumn("h", F.xxhash64("v")), ["h", "v"], [F.col("id")], k + 1)
    nodes = stage(member.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    queries = stage(rows.where("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct(), "queries")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.select(F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"), "h", "v")
    kind = "shard int, h long, v array<double>, place int, edges array<int>, entry boolean"
    graphs = stage(dealt.groupBy("shard").applyInArrow(build, kind), "graphs")
    n_queries = queries.count()
    asked = blocks(queries, n_queries, shards, block_queries)
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n_queries // block_queries) - 1)))))
    pair = ["shard", "block"]
    found = held.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(lambda left, right: answer(left, right, k, search_beam), "query_id long, h long")
    # ids and vectors come back in Spark; two vectors of one hash are both candidates, and their scores are exact
    scored = found.distinct().join(nodes, "h").join(queries, "query_id").select("query_id", F.explode("ids").alias("vec_id"), cosine(F.col("q"), F.col("v")).alias("score"))
    scored = scored.where("query_id != vec_id")
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, summed in order of the components."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda acc, z: acc + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
