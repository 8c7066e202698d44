"""Weighted record linkage with an explicit *ambiguous* outcome.

Scores are integers in thousandths. A record linked to a later one is the ingress, the later one the
egress. The signals compare attributes, apart from one that falls with the time between the two
records. Records with equal attributes are therefore interchangeable but for time, and scoring is
done between *classes* of equal records:

1. distinct attribute tuples become classes, per scope (a capture, a customer ...);
2. classes meet through blocks: sets of keys of which at least one must agree for any pair that can
   reach the threshold;
3. for an ingress record and a class, the nearest later members score highest, so the two nearest
   and the number of later members say all that ranking and the ambiguity test need. They come from
   an ordered scan over the members of both classes.

So a group of copies, however large, costs its own rows and not its pairs. Scopes of few records (counted,
``SCOPE_RECORDS``) need neither blocks nor scans: their records are brought together once and compared there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.ordered import epoch_us
from sigspark.plans.slices import Scanner, hot_keys, join_null_safe, last_value, running_sum, top_per
from sigspark.session import int_conf, stage

THRESHOLD = 500
MARGIN = 150
# Scored pairs of one scope that a single task may match.
MATCH_PAIRS_CONF = "spark.sigspark.maxMatchPairs"
MATCH_PAIRS = 500_000
# Records of one scope that are compared pair by pair where the scope lies.
SCOPE_RECORDS_CONF = "spark.sigspark.maxScopeRecords"
SCOPE_RECORDS = 64
# Records that a task holds while it compares those of small scopes.
TASK_RECORDS = 250_000
SEPARATOR, ABSENT = "\u0001", "\u0002"


@dataclass(frozen=True)
class Signal:
    """``expr(l, r)`` is true (or a share of 1.0) when the attributes ``l`` and ``r`` agree."""

    name: str
    points: int
    expr: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Proximity:
    """Points falling linearly to 0 at ``window_us`` after the ingress."""

    points: int
    window_us: int


@dataclass(frozen=True)
class Block:
    """Attribute names that must be equal on both sides (one of them may be an array: any element).

    ``near`` adds: some members lie within the proximity window. ``right_if`` restricts the egress.
    """

    columns: tuple[str, ...]
    near: bool = False
    right_if: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Linkage:
    scope: tuple[str, ...]
    attributes: tuple[str, ...]
    signals: tuple[Signal, ...]
    blocks: tuple[Block, ...]
    proximity: Proximity
    threshold: int = THRESHOLD
    margin: int = MARGIN

    def __post_init__(self):
        if not self.blocks:
            raise ValueError("linkage needs blocks: comparing all records is refused")


def with_classes(nodes: DataFrame, link: Linkage) -> DataFrame:
    """Nodes (scope, node_id, start_ts, ord, attributes) with the id of their class."""
    # equal attributes, equal class; the 128 bits of md5 make chance equality negligible
    attrs = F.struct(*link.attributes)
    text = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(ABSENT)) for c in link.attributes])
    classed = nodes.select(
        *link.scope, "node_id", epoch_us(F.col("start_ts")).alias("t"), F.col("ord").cast("string").alias("ord"),
        attrs.alias("a"), F.unhex(F.md5(text)).alias("cls"),
    )
    return stage(classed, "linkage-nodes")  # read half a dozen times from here on


def _block_keys(nodes: DataFrame, link: Linkage, side: str) -> DataFrame:
    """(scope, k, class): a hash of every block key of every class, all blocks in one pass.

    Keys that share a hash by chance bring classes together that scoring then drops.
    """
    a, w = F.col("a"), link.proximity.window_us
    groups = []
    for no, block in enumerate(link.blocks):
        arrays = [c for c in block.columns if nodes.schema["a"].dataType[c].dataType.typeName() == "array"]
        plain = [a[c] for c in block.columns if c not in arrays]
        usable = F.lit(True)
        for c in plain:
            usable = usable & c.isNotNull()
        if side == "r" and block.right_if is not None:
            usable = usable & F.coalesce(block.right_if(a), F.lit(False))
        # the egress lies in the bucket of the ingress or in the next one
        at = F.floor(F.col("t") / w)
        buckets = ([at, at + 1] if side == "l" else [at]) if block.near else [F.lit(0).cast("bigint")]
        items = a[arrays[0]] if arrays else None
        groups.append(F.when(usable, _spread(no, plain, items, buckets)))
    groups = [F.coalesce(g, F.array().cast("array<bigint>")) for g in groups]
    keys = nodes.select(*link.scope, F.col("cls").alias(side + "_cls"), F.explode(F.flatten(F.array(*groups))).alias("k"))
    return keys.distinct()


def _spread(no: int, plain: list[Column], items: Column | None, buckets: list[Column]) -> Column:
    def key(bucket: Column, *item: Column) -> Column:
        return F.xxhash64(F.lit(no), *plain, *item, bucket)

    if items is None:
        return F.array(*[key(b) for b in buckets])
    return F.concat(*[_each(items, b, key) for b in buckets])


def _each(items: Column, bucket: Column, key) -> Column:
    return F.transform(items, lambda x: key(bucket, x))


def class_pairs(nodes: DataFrame, link: Linkage) -> DataFrame:
    """Pairs of classes some of whose members can reach the threshold, with their score without time."""
    on = [*link.scope, "k"]
    found = _block_keys(nodes, link, "l").join(_block_keys(nodes, link, "r"), on)
    found = found.select(*link.scope, "l_cls", "r_cls").distinct()
    classes = nodes.groupBy(*link.scope, "cls").agg(F.first("a").alias("a"))
    left = classes.select(*link.scope, F.col("cls").alias("l_cls"), F.col("a").alias("l"))
    right = classes.select(*link.scope, F.col("cls").alias("r_cls"), F.col("a").alias("r"))
    both = found.join(left, [*link.scope, "l_cls"]).join(right, [*link.scope, "r_cls"])
    base = score(link, F.col("l"), F.col("r"))
    return both.select(*link.scope, "l_cls", "r_cls", base.alias("base")).where(
        F.col("base") + link.proximity.points >= link.threshold
    )


def _points(signal: Signal, left: Column, right: Column) -> Column:
    hit = F.coalesce(signal.expr(left, right).cast("double"), F.lit(0.0))
    return F.floor(hit * signal.points + 0.5).cast("bigint")


def score(link: Linkage, left: Column, right: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for s in link.signals:
        total = total + _points(s, left, right)
    return total


def matched_signals(link: Linkage, left: Column, right: Column, dt_us: Column) -> Column:
    """ARRAY<STRUCT<name,points>> of the signals that fired."""
    parts = [F.struct(F.lit(s.name).alias("name"), _points(s, left, right).alias("points")) for s in link.signals]
    parts.append(F.struct(F.lit("temporal").alias("name"), _near_points(link, F.lit(0), dt_us).alias("points")))
    return F.filter(F.array(*parts), lambda x: x["points"] > 0)


def _near_points(link: Linkage, base: Column, dt: Column) -> Column:
    """base + points * (1 - dt/window), rounded half up and at most 1000."""
    p, w = link.proximity.points, link.proximity.window_us
    inside = dt.isNotNull() & (dt >= 0) & (dt < w)
    total = F.floor(base + F.when(inside, p * (w - dt) / w).otherwise(0.0) + 0.5).cast("bigint")
    return F.least(F.lit(1000).cast("bigint"), total)


def candidates(nodes: DataFrame, link: Linkage, pairs: DataFrame | None = None) -> DataFrame:
    """Per ingress record and egress class: number of candidates, the two best and their scores.

    Rows: scope, node_id, t, ord, l_cls, r_cls, base, n, best_id, best, second_id, second.
    """
    scope = list(link.scope)
    if pairs is not None:
        return stage(_candidates_by_class(nodes, link, pairs), "candidates")
    n_large, _, large = hot_keys(nodes, scope, int_conf(nodes.sparkSession, SCOPE_RECORDS_CONF, SCOPE_RECORDS))
    if not n_large:
        return stage(_candidates_in_scope(nodes, link), "candidates")
    large = stage(large, "large-scopes")
    rest = stage(join_null_safe(nodes, large, scope, "left_semi"), "large-scopes")
    out = _candidates_in_scope(join_null_safe(nodes, large, scope, "left_anti"), link).unionByName(_candidates_by_class(rest, link, class_pairs(rest, link)))
    return stage(out, "candidates")


def _blocked(link: Linkage, left: Column, right: Column, lt: Column, rt: Column, arrays: Sequence[str]) -> Column:
    """True when two records share a key of a block, as ``_block_keys`` makes them."""
    found, w = F.lit(False), link.proximity.window_us
    for block in link.blocks:
        same = F.lit(True)
        for c in block.columns:
            same = same & F.coalesce(F.arrays_overlap(left[c], right[c]) if c in arrays else left[c] == right[c], F.lit(False))
        if block.near:
            at, then = F.floor(lt / w), F.floor(rt / w)
            same = same & (at.eqNullSafe(then) | (at + 1).eqNullSafe(then))
        if block.right_if is not None:
            same = same & F.coalesce(block.right_if(right), F.lit(False))
        found = found | same
    return found


def _within(link: Linkage, base: Column, t: Column, et: Column) -> Column:
    """Whether an egress at ``et`` counts: one that needs time points does up to the distance that still reaches the threshold."""
    p, w = link.proximity.points, link.proximity.window_us
    reach = F.least(F.lit(w - 1), F.floor((p - (link.threshold - base) + 0.5) * w / p).cast("bigint"))
    # as structs, nulls come first, as in the order of a scan
    return (base >= link.threshold) | ~(F.struct(et) > F.struct(t + reach))


def _candidates_in_scope(nodes: DataFrame, link: Linkage) -> DataFrame:
    """``candidates`` for scopes of few records: all steps after the one shuffle by scope stay where the scope lies."""
    scope = list(link.scope)
    arrays = [f.name for f in nodes.schema["a"].dataType.fields if f.dataType.typeName() == "array"]
    # parts by their count (told by the written table), not by their few bytes
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // TASK_RECORDS))
    near = nodes.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in scope], F.lit(True))).repartition(parts, *scope)
    # of a record that comes twice in its class, the last one asks
    last = Window.partitionBy(*scope, "cls", "node_id").orderBy(F.col("t").desc(), F.col("ord").desc())
    record = F.struct("t", "ord", "node_id", "cls", "a", (F.row_number().over(last) == 1).alias("asks"))
    records = near.select(*scope, record.alias("r")).groupBy(*scope).agg(F.collect_list("r").alias("rs"))
    both = records.select(*scope, "rs", F.explode("rs").alias("l")).where("l.asks").select(*scope, "l", F.explode("rs").alias("r"))
    l, r = F.col("l"), F.col("r")
    both = both.withColumn("base", score(link, l["a"], r["a"])).where(F.col("base") + link.proximity.points >= link.threshold)
    later = F.struct(r["t"], r["ord"]) > F.struct(l["t"], l["ord"])
    met = both.select(
        *scope, l["cls"].alias("l_cls"), r["cls"].alias("r_cls"), "base", l["node_id"].alias("node_id"), l["t"].alias("t"), l["ord"].alias("ord"),
        F.struct(r["t"].alias("t"), r["ord"].alias("ord"), r["node_id"].alias("id")).alias("e"),
        (later & _within(link, F.col("base"), l["t"], r["t"])).alias("counts"), _blocked(link, l["a"], r["a"], l["t"], r["t"], arrays).alias("hit"),
    )
    # classes meet as soon as one pair of their members shares a block
    met = met.withColumn("hit", F.max("hit").over(Window.partitionBy(*scope, "l_cls", "r_cls"))).where(F.col("hit") & F.col("counts"))
    out = met.groupBy(*scope, "l_cls", "r_cls", "base", "node_id", "t", "ord").agg(F.array_sort(F.collect_list("e")).alias("es"))
    best, second = F.get("es", F.lit(0)), F.get("es", F.lit(1))
    return out.select(
        *scope, "l_cls", "r_cls", "base", "node_id", "t", "ord", F.size("es").cast("bigint").alias("n"),
        best["id"].alias("best_id"), _near_points(link, F.col("base"), best["t"] - F.col("t")).alias("best"),
        second["id"].alias("second_id"), F.when(F.size("es") > 1, _near_points(link, F.col("base"), second["t"] - F.col("t"))).alias("second"),
    )


def _candidates_by_class(nodes: DataFrame, link: Linkage, pairs: DataFrame) -> DataFrame:
    """``candidates`` for scopes of any size."""
    # read by the count of group sizes and by both sides of the scan: worth one write each
    pairs = stage(pairs, "class-pairs")
    scope, p, w = list(link.scope), link.proximity.points, link.proximity.window_us
    rel = [*scope, "l_cls", "r_cls"]
    slim = nodes.select(*scope, "node_id", "t", "ord", "cls")
    ingress = pairs.join(slim.withColumnRenamed("cls", "l_cls"), [*scope, "l_cls"])
    egress = pairs.join(slim.withColumnRenamed("cls", "r_cls"), [*scope, "r_cls"])
    # a class that needs time points counts members up to the distance that still reaches the threshold
    reach = F.least(
        F.lit(w - 1), F.floor((p - (link.threshold - F.col("base")) + 0.5) * w / p).cast("bigint")
    )
    bounded = F.col("base") < link.threshold
    cols = [*rel, "base", "node_id"]
    e = egress.select(*cols, "t", F.lit(0).alias("late"), "ord", F.lit(0).alias("o"))
    i = ingress.select(*cols, "t", F.lit(0).alias("late"), "ord", F.lit(1).alias("o"))
    h = ingress.where(bounded).select(*cols, (F.col("t") + reach).alias("t"), F.lit(1).alias("late"), "ord", F.lit(2).alias("o"))
    is_e = F.col("o") == 0
    # a class pair has each member of its classes once per kind of row
    largest = nodes.groupBy(*scope, "cls").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    s = Scanner(e.unionByName(i).unionByName(h), rel, ["t", "late", "ord", "o", "node_id"], known_max=3 * largest)
    mark = F.when(is_e, F.struct(F.col("node_id").alias("id"), F.col("t").alias("t")))
    s.add(e1=last_value(mark, inclusive=False, reverse=True), after=running_sum(is_e.cast("bigint"), inclusive=False, reverse=True))
    s.with_column("_own", F.when(is_e, F.struct("e1")))
    s.add(e2=last_value(F.col("_own"), inclusive=False, reverse=True))
    rows = s.df.where(~is_e)
    out = rows.groupBy(*rel, "base", "node_id").agg(
        F.max(F.when(F.col("o") == 1, F.struct("t", "ord", "e1", "e2", "after"))).alias("i"),
        F.max(F.when(F.col("o") == 2, F.coalesce("after", F.lit(0)))).alias("beyond"),
    )
    n = F.coalesce(F.col("i.after"), F.lit(0)) - F.coalesce("beyond", F.lit(0))
    t = F.col("i.t")
    out = out.select(
        *rel, "base", "node_id", t.alias("t"), F.col("i.ord").alias("ord"), n.alias("n"),
        F.col("i.e1.id").alias("best_id"), _near_points(link, F.col("base"), F.col("i.e1.t") - t).alias("best"),
        F.col("i.e2.e1.id").alias("second_id"), _near_points(link, F.col("base"), F.col("i.e2.e1.t") - t).alias("second"),
    ).where(F.col("n") > 0)
    two = F.col("n") >= 2
    out = out.withColumn("second_id", F.when(two, F.col("second_id"))).withColumn("second", F.when(two, F.col("second")))
    return out


def rank_candidates(cand: DataFrame, link: Linkage) -> DataFrame:
    """Per ingress: number of candidates, best and second-best score, and whether they are too close."""
    key = [*link.scope, "node_id"]
    total = cand.groupBy(*key).agg(F.sum("n").alias("n_candidates"))
    both = cand.select(
        *key,
        F.explode(F.array(
            F.struct(F.col("best_id").alias("id"), F.col("best").alias("score")),
            F.struct(F.col("second_id").alias("id"), F.col("second").alias("score")),
        )).alias("c"),
    ).where(F.col("c.id").isNotNull())
    top = top_per(both.select(*key, "c.id", "c.score"), key, [F.col("score").desc(), F.col("id")], 2)
    best = top.groupBy(*key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second_id"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    close = F.coalesce(F.col("best") - F.col("second") <= link.margin, F.lit(False))
    return best.join(total, key).withColumn("ambiguous", close)


def split_ambiguous(nodes: DataFrame, cand: DataFrame, link: Linkage) -> tuple[DataFrame, DataFrame]:
    """(pool, ambiguous): the scored pairs of clear ingress records, and the refused records.

    The members of a class are listed only for clear ingress records. Their best class has a single
    candidate (two members of one class differ by the time points, which do not exceed the margin);
    the lower classes are listed because matching may fall back to them.
    """
    if link.proximity.points > link.margin:
        raise ValueError("time points above the margin would let two members of a class be clear")
    ranked = rank_candidates(cand, link)
    key = [*link.scope, "node_id"]
    ambiguous = ranked.where("ambiguous")
    clear = cand.join(ranked.where(~F.col("ambiguous")).select(*key), key, "left_semi")
    single = clear.where(F.col("n") == 1).select(
        *link.scope, F.col("node_id").alias("ingress"), "t", F.col("best_id").alias("egress"), F.col("best").alias("score")
    )
    slim = nodes.select(*link.scope, F.col("cls").alias("r_cls"), F.col("node_id").alias("egress"), F.col("t").alias("et"), F.col("ord").alias("eord"))
    many = clear.where(F.col("n") > 1).join(slim, [*link.scope, "r_cls"])
    later = (F.col("et") > F.col("t")) | ((F.col("et") == F.col("t")) & (F.col("eord") > F.col("ord")))
    many = many.where(later).select(
        *link.scope, F.col("node_id").alias("ingress"), "t", "egress",
        _near_points(link, F.col("base"), F.col("et") - F.col("t")).alias("score"),
    )
    return single.unionByName(many.where(F.col("score") >= link.threshold)), ambiguous


def match_greedy(pool: DataFrame, scope: Sequence[str], margin: int = MARGIN) -> tuple[DataFrame, DataFrame]:
    """One-to-one matching, best score first: (accepted, contended egress records).

    The sequential rule takes pairs by (score down, ingress time, ingress, egress); a pair whose
    egress has another free ingress within the margin bars that egress instead.

    Nothing is shared between scopes, so a scope whose pairs fit a task (counted, ``MATCH_PAIRS``) is matched there by the rule as
    it stands, however long its chains of dependent pairs. Larger scopes are matched in rounds.
    """
    scope = list(scope)
    cols = [*scope, "ingress", "t", "egress", "score"]
    pool = stage(pool.select(*cols), "match-pool")
    limit = int_conf(pool.sparkSession, MATCH_PAIRS_CONF, MATCH_PAIRS)
    n_large, _, large = hot_keys(pool, scope, limit)
    small = join_null_safe(pool, stage(large, "match-large"), scope, "left_anti") if n_large else pool
    done = stage(_match_in_order(small, scope, margin), "matched")
    accepted, contended = done.where("n_rivals = 0").select(*cols), done.where("n_rivals > 0")
    if n_large:
        more, barred = _match_in_rounds(join_null_safe(pool, large, scope, "left_semi"), scope, margin)
        accepted, contended = accepted.unionByName(more), contended.unionByName(barred.select(*contended.columns))
    return accepted, contended


def _match_in_order(pool: DataFrame, scope: list[str], margin: int) -> DataFrame:
    """Pairs settled by the sequential rule, one scope at a time, with the number of rivals that bar their egress (0: accepted)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields) + ", n_rivals bigint"

    def run(table: pa.Table) -> pa.Table:
        ingress, t, egress, score = (table.column(c).to_pylist() for c in ("ingress", "t", "egress", "score"))
        order = sorted(range(len(score)), key=lambda i: (-score[i], t[i], ingress[i], egress[i]))
        asking: dict = {}
        for i in order:
            asking.setdefault(egress[i], []).append(i)
        taken, settled, row, rivals = set(), set(), [], []
        for i in order:
            if ingress[i] in taken or egress[i] in settled:
                continue
            # every egress comes here once
            settled.add(egress[i])
            row.append(i)
            rivals.append(sum(1 for j in asking[egress[i]] if j != i and ingress[j] not in taken and score[i] - score[j] <= margin))
            if not rivals[-1]:
                taken.add(ingress[i])
        return table.take(pa.array(row, pa.int64())).append_column("n_rivals", pa.array(rivals, pa.int64()))

    return pool.groupBy(*scope).applyInArrow(run, schema)


def _match_in_rounds(pool: DataFrame, scope: list[str], margin: int) -> tuple[DataFrame, DataFrame]:
    """The same matching for scopes of any size.

    A pair is decidable when it comes first among the open pairs of
    its ingress and of its egress, and no rival within the margin could still be taken by an earlier
    pair, that is, no rival's ingress has an open pair before it. All decidable pairs of a round are
    settled together, and the open pairs they touch drop out. The first open pair of all is always
    decidable, so the rounds end. Every step is an aggregate or an equi-join; each round is staged.
    """
    cols = [*scope, "ingress", "t", "egress", "score"]
    key = F.struct((-F.col("score")).alias("s"), F.col("t").alias("t"), F.col("ingress").alias("i"), F.col("egress").alias("e"))
    edges = stage(pool.withColumn("key", key), "match-pool")
    accepted, barred = [], []
    while not edges.isEmpty():
        by_in = edges.groupBy(*scope, "ingress").agg(F.min("key").alias("first_in"))
        seen = edges.join(by_in, [*scope, "ingress"])
        heads = edges.groupBy(*scope, "egress").agg(F.min("key").alias("head"))
        # rivals of the head of each egress: its other open pairs within the margin
        others = seen.join(heads, [*scope, "egress"]).where(
            (F.col("key") != F.col("head")) & (F.col("score") >= -F.col("head.s") - margin)
        )
        rivals = others.groupBy(*scope, "egress").agg(
            F.min("first_in").alias("rival_first"),
            F.count(F.lit(1)).alias("n_rivals"),
        )
        state = seen.join(heads, [*scope, "egress"]).where(F.col("key") == F.col("head"))
        state = state.join(rivals, [*scope, "egress"], "left")
        ready = (F.col("first_in") == F.col("key")) & (
            F.col("rival_first").isNull() | (F.col("rival_first") >= F.col("key"))
        )
        done = stage(state.where(ready).select(*cols, F.coalesce("n_rivals", F.lit(0)).alias("n_rivals")), "match-round")
        take = done.where(F.col("n_rivals") == 0)
        accepted.append(take.select(*cols))
        barred.append(done.where(F.col("n_rivals") > 0))
        left = edges.join(take.select(*scope, "ingress"), [*scope, "ingress"], "left_anti")
        left = left.join(done.select(*scope, "egress"), [*scope, "egress"], "left_anti")
        edges = stage(left, "match-pool")
    if not accepted:
        none = pool.select(*cols).limit(0)
        return none, none.withColumn("n_rivals", F.lit(0).cast("bigint"))
    return _union(accepted), _union(barred)


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def merge_chains(accepted: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, node_id, root) of linked records: A-B and B-C make one chain A, B, C.

    Each record has at most one earlier and one later partner, so chains are paths; every record
    learns its first record by doubling the known distance, in a logarithmic number of joins.
    """
    scope = list(scope)
    heads = accepted.select(*scope, F.col("egress").alias("node_id"), F.col("ingress").alias("up"))
    roots = accepted.select(*scope, F.col("ingress").alias("node_id")).join(heads, [*scope, "node_id"], "left_anti")
    links = stage(heads.unionByName(roots.withColumn("up", F.col("node_id"))), "chains")
    while True:
        nxt = links.select(*scope, F.col("node_id").alias("up"), F.col("up").alias("up2"))
        step = links.join(nxt, [*scope, "up"]).select(*scope, "node_id", "up", "up2")
        step = stage(step, "chains")
        if step.where(F.col("up") != F.col("up2")).isEmpty():
            return links.withColumnRenamed("up", "root")
        links = step.select(*scope, "node_id", F.col("up2").alias("up"))


def build_calls(nodes: DataFrame, accepted: DataFrame, contended: DataFrame, ambiguous: DataFrame, scope: Sequence[str]):
    """(calls, call_nodes). Every node is in exactly one call: paired, ambiguous or unpaired."""
    scope = list(scope)
    chains = merge_chains(accepted, scope)
    t = nodes.select(*scope, "node_id", "t", "ord")
    edge = accepted.join(chains.withColumnRenamed("node_id", "ingress"), [*scope, "ingress"])
    conf = edge.groupBy(*scope, "root").agg(F.min("score").alias("confidence"), F.count(F.lit(1)).alias("n_pairings"))
    flagged = (
        ambiguous.select(*scope, "node_id", F.col("best").alias("amb_best"))
        .unionByName(contended.select(*scope, F.col("egress").alias("node_id"), F.col("score").alias("amb_best")))
        .groupBy(*scope, "node_id").agg(F.max("amb_best").alias("amb_best"))
    )
    single = t.join(chains, [*scope, "node_id"], "left_anti").join(flagged, [*scope, "node_id"], "left")
    single = single.withColumn("root", F.col("node_id")).withColumn(
        "state", F.when(F.col("amb_best").isNotNull(), "ambiguous").otherwise("unpaired")
    )
    paired = t.join(chains, [*scope, "node_id"]).withColumn("amb_best", F.lit(None).cast("bigint")).withColumn("state", F.lit("paired"))
    call_nodes = paired.unionByName(single.select(*paired.columns))
    calls = call_nodes.groupBy(*scope, "root").agg(
        F.first("state").alias("state"), F.min(F.struct("t", "ord", "node_id")).alias("_first"),
        F.count(F.lit(1)).alias("n_nodes"), F.max("amb_best").alias("amb_best"),
    )
    calls = calls.join(conf, [*scope, "root"], "left").select(
        *scope, "root", "state", "n_nodes",
        F.coalesce("confidence", "amb_best", F.lit(0)).cast("bigint").alias("confidence"),
        F.coalesce("n_pairings", F.lit(0)).alias("n_pairings"),
        F.timestamp_micros(F.col("_first.t")).alias("start_ts"), F.col("_first.ord").alias("first_ord"),
    )
    return calls, call_nodes.select(*scope, "root", "node_id", "t")


def pair_candidates(pairs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scored pairs (scope, ingress, t, ord, egress, score) in the form of ``candidates``."""
    none, no_class = F.lit(None).cast("string"), F.lit(None).cast("binary")
    return pairs.select(
        *scope, no_class.alias("l_cls"), no_class.alias("r_cls"), F.col("score").alias("base"), F.col("ingress").alias("node_id"), "t", "ord",
        F.lit(1).cast("bigint").alias("n"), F.col("egress").alias("best_id"), F.col("score").alias("best"),
        none.alias("second_id"), F.lit(None).cast("bigint").alias("second"),
    )


def link(nodes: DataFrame, spec: Linkage, extra: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole linkage: candidates, ambiguous records, pool, accepted pairs, calls.

    ``extra``: candidates of another kind of pair (see ``pair_candidates``) that compete with them.
    """
    classed = with_classes(nodes, spec)
    cand = candidates(classed, spec)
    if extra is not None:
        cand = stage(cand.unionByName(extra), "candidates")
    pool, ambiguous = split_ambiguous(classed, cand, spec)
    accepted, contended = match_greedy(pool, spec.scope, spec.margin)
    calls, call_nodes = build_calls(classed, accepted, contended, ambiguous, spec.scope)
    return {
        "candidates": cand, "ambiguous": ambiguous, "pool": pool, "accepted": accepted,
        "contended": contended, "calls": calls, "call_nodes": call_nodes,
        "pair_signals": pair_signals(classed, accepted, spec),
    }


def pair_signals(classed: DataFrame, accepted: DataFrame, spec: Linkage) -> DataFrame:
    """The signals that speak for each accepted pair, one row per signal."""
    scope = list(spec.scope)
    left = classed.select(*scope, F.col("node_id").alias("ingress"), F.col("a").alias("l"), F.col("t").alias("lt"))
    right = classed.select(*scope, F.col("node_id").alias("egress"), F.col("a").alias("r"), F.col("t").alias("rt"))
    both = accepted.join(left, [*scope, "ingress"]).join(right, [*scope, "egress"])
    fired = matched_signals(spec, F.col("l"), F.col("r"), F.col("rt") - F.col("lt"))
    return both.select(*scope, "ingress", "egress", "score", F.explode(fired).alias("s")).select(
        *scope, "ingress", "egress", "score", F.col("s.name").alias("signal"), F.col("s.points").alias("points")
    )
