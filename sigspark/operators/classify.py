"""Classification over facts: weighted labels, feature indicators, rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.rollups import severity_rank
from sigspark.plans.slices import top_per


@dataclass(frozen=True)
class Test:
    """``points`` (thousandths) for ``label`` when the predicate over a facts row holds."""

    label: str
    name: str
    points: int
    predicate: Column


@dataclass(frozen=True)
class Indicator:
    """State of a feature: the first of issue, on, partial that holds, else off."""

    key: str
    on: Column
    partial: Column | None = None
    issue: Column | None = None


@dataclass(frozen=True)
class Rule:
    """Rows of a frame that match, with severity and evidence. ``rows`` gives capture_id and the rest."""

    rule_id: str
    severity: str
    rows: Callable[[], DataFrame]
    evidence: Column | None = None


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def score_labels(facts: DataFrame, keys: Sequence[str], tests: Sequence[Test], unknown_below: int = 350, close: int = 100) -> DataFrame:
    """Best label per facts row with confidence (thousandths), signals and alternatives.

    The labels are few and fixed, so they are ranked inside the row: no shuffle.
    """
    labels = list(dict.fromkeys(t.label for t in tests))
    scored = []
    for no, label in enumerate(labels):
        own = [t for t in tests if t.label == label]
        total = reduce(lambda a, b: a + b, [F.when(_true(t.predicate), t.points).otherwise(0) for t in own])
        signals = F.array_compact(F.array(*[F.when(_true(t.predicate), F.lit(t.name)) for t in own]))
        scored.append(F.struct(total.alias("score"), F.lit(-no).alias("no"), F.lit(label).alias("label"), signals.alias("signals")))
    ranked = F.sort_array(F.array(*scored), asc=False)
    df = facts.select(*keys, ranked.alias("_r"))
    top, second = F.element_at("_r", 1), F.element_at("_r", 2)
    unknown = top["score"] < unknown_below
    near = (top["score"] - second["score"]) < close
    conf = F.least(F.lit(950), top["score"])
    conf = F.when(near, F.greatest(F.lit(300), conf - 150)).otherwise(conf)
    others = F.slice(F.filter(F.slice("_r", 2, len(labels)), lambda x: x["score"] > 50), 1, 4)
    return df.select(
        *keys,
        F.when(unknown, "unknown").otherwise(top["label"]).alias("label"),
        F.when(unknown, F.least(F.lit(300), top["score"])).otherwise(conf).cast("bigint").alias("confidence"),
        F.when(unknown, F.slice(top["signals"], 1, 4)).when(near, F.concat(top["signals"], F.array(F.lit("close-alternative")))).otherwise(top["signals"]).alias("signals"),
        F.transform(others, lambda x: F.struct(x["label"].alias("label"), F.least(F.lit(950), x["score"]).alias("confidence"))).alias("alternatives"),
    )


def indicators(facts: DataFrame, keys: Sequence[str], spec: Sequence[Indicator]) -> DataFrame:
    """One row per facts row and key, in the order of the spec, all keys always present."""
    parts = []
    for no, i in enumerate(spec):
        state = F.lit("off")
        if i.partial is not None:
            state = F.when(_true(i.partial), "partial").otherwise(state)
        state = F.when(_true(i.on), "on").otherwise(state)
        if i.issue is not None:
            state = F.when(_true(i.issue), "issue").otherwise(state)
        parts.append(F.struct(F.lit(no).alias("pos"), F.lit(i.key).alias("key"), state.alias("state")))
    return facts.select(*keys, F.explode(F.array(*parts)).alias("i")).select(*keys, "i.pos", "i.key", "i.state")


def markers(headers: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set of markers per key: exploded header names joined with the marker table, counted distinct."""
    return headers.join(lookup, "name").select(*keys, "marker").distinct()


# What a match is about, as columns: rows of a rule may have them.
SUBJECTS = ["leg_id", "call_no"]


def with_subjects(rows: DataFrame) -> DataFrame:
    """``rows`` with every subject column as a string, null where it had none."""
    return rows.withColumns({c: (F.col(c) if c in rows.columns else F.lit(None)).cast("string") for c in SUBJECTS})


def run_rules(rules: Sequence[Rule], scope: Sequence[str] = ("capture_id",), per_rule: int = 8, total: int = 60) -> tuple[DataFrame, DataFrame]:
    """(advice, matches). ``matches`` has every match with its subjects; ``advice`` is the report: at most ``per_rule``
    matches of a rule and ``total`` rows per scope, gravest first."""
    parts = []
    for no, rule in enumerate(rules):
        rows = rule.rows()
        evidence = rule.evidence if rule.evidence is not None else F.lit("")
        sev = F.col("severity") if "severity" in rows.columns else F.lit(rule.severity)
        told = rows.withColumn("_sev", sev).withColumn("_evidence", evidence.cast("string"))
        own = with_subjects(told)
        parts.append(own.select(*scope, F.lit(rule.rule_id).alias("rule_id"), F.lit(no).alias("rule_no"), F.col("_sev").alias("severity"), F.col("_evidence").alias("evidence"), *SUBJECTS))
    matches = reduce(lambda a, b: a.unionByName(b), parts)
    capped = top_per(matches, [*scope, "rule_id"], [severity_rank(F.col("severity")), F.col("evidence")], per_rule).drop("rank")
    advice = top_per(capped, scope, [severity_rank(F.col("severity")), F.col("rule_no"), F.col("evidence")], total)
    return advice, matches


def rank_fixes(fixes: DataFrame, vendors: DataFrame, scope: Sequence[str] = ("capture_id",), n: int = 6) -> DataFrame:
    """Fixes of each rule: those for vendors seen in the scope, then generic, network, other vendors."""
    seen = vendors.select(*scope, "vendor").distinct().withColumn("_seen", F.lit(1))
    out = fixes.join(seen, [*scope, "vendor"], "left")
    tier = F.when(F.col("_seen") == 1, 0).when(F.col("vendor") == "generic", 1).when(F.col("vendor") == "network", 2).otherwise(3)
    return top_per(out.withColumn("tier", tier).drop("_seen"), [*scope, "rule_id"], [F.col("tier"), F.col("vendor"), F.col("fix")], n)


def worst_severity(ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gravest severity per id from findings and advice; ``source`` findings win over advice."""
    rank = F.struct(F.when(F.col("source") == "finding", 0).otherwise(1), severity_rank(F.col("severity")))
    return ids.groupBy(*keys).agg(
        F.min_by("severity", rank).alias("severity"), F.count_if(F.col("source") == "finding").alias("n_findings"), F.count_if(F.col("source") == "advice").alias("n_advice")
    )


def merge_findings(frames: Sequence[DataFrame], known: DataFrame, kind: str) -> DataFrame:
    """Union of findings without duplicates and without references to unknown ids.

    ``frames``: capture_id, severity, category, title, ids ARRAY. ``known``: capture_id, id.
    """
    base = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).dropDuplicates(["capture_id", "severity", "category", "title", kind])
    key = ["capture_id", "severity", "category", "title"]
    base = base.withColumn("_fid", F.md5(F.concat_ws("\u0001", *key, F.concat_ws(",", kind))))
    refs = base.select("capture_id", "_fid", F.explode(kind).alias("id")).join(known, ["capture_id", "id"], "left_semi")
    # a finding names a handful of ids; it is one row with an array in the input as well
    kept = refs.groupBy("capture_id", "_fid").agg(F.sort_array(F.collect_set("id")).alias("_ids"))
    out = base.join(kept, ["capture_id", "_fid"], "left")
    return out.withColumn(kind, F.coalesce("_ids", F.array().cast("array<string>"))).drop("_ids", "_fid")
