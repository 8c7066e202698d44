"""Configured header rules against observed changes, and conflicts among rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.net import ips_in
from sigspark.functions.sip import canonical
from sigspark.plans.slices import join_null_safe, top_per
from sigspark.session import stage

# Change tags a header rule can cause.
MANIP_TAGS = [
    "header-stripped", "header-added", "header-rewritten", "from-rewritten", "to-rewritten",
    "private-ip-leak", "dtmf-pt-mismatch", "session-timer-changed", "session-timer-conflict",
    "100rel-asymmetry", "codec-narrowed",
]
WRITE_OPS = ["add", "delete", "modify", "replace"]


ANY = "*"
# Which change a rule causes: (headers, operations, elements, words of its value or conditions, tag); ANY fits everything.
EFFECTS = [
    (ANY, ["add"], ANY, ANY, "header-added"),
    (ANY, ["delete"], ANY, ANY, "header-stripped"),
    (ANY, ["modify", "replace"], ANY, ANY, "header-rewritten"),
    (["from"], ["modify", "replace"], ["uri.user", "uri", "value"], ANY, "from-rewritten"),
    (["to", "request-uri"], ["modify", "replace"], ["uri.user", "uri", "value"], ANY, "to-rewritten"),
    (["min-se", "session-expires"], ANY, ANY, ANY, "session-timer-changed"),
    (["min-se", "session-expires"], ANY, ANY, ANY, "session-timer-conflict"),
    (["require", "supported", "unsupported"], ANY, ANY, ["100rel"], "100rel-asymmetry"),
    (ANY, ANY, ANY, ["telephone-event"], "dtmf-pt-mismatch"),
    (["sdp body"], ANY, ANY, ANY, "codec-narrowed"),
    (["sdp body"], ANY, ANY, ANY, "dtmf-pt-mismatch"),
    (ANY, ANY, ANY, ["value:rtpmap", "value:m=audio"], "codec-narrowed"),
    (ANY, ANY, ANY, ["value:rtpmap", "value:m=audio"], "dtmf-pt-mismatch"),
]
# Tags of a change that always concern one header.
HEADER_OF = {"from-rewritten": "from", "to-rewritten": "to"}


def expected_tags(header: Column, element: Column, operation: Column, value: Column, condition_text: Column) -> Column:
    """ARRAY of the change tags a rule would cause if it fired between two legs: the rows of ``EFFECTS`` that fit it."""
    name = canonical(F.coalesce(header, F.lit("")))
    of_value = F.lower(F.coalesce(value, F.lit("")))
    anywhere = F.lower(F.concat_ws(" ", value, condition_text))
    part = F.coalesce(element, F.lit("value"))

    def fits(headers, operations, elements, words) -> Column:
        tests = [F.lit(True)]
        tests += [] if headers == ANY else [name.isin(headers) | F.lower(F.coalesce(header, F.lit(""))).isin(headers)]
        tests += [] if operations == ANY else [operation.isin(operations)]
        tests += [] if elements == ANY else [part.isin(elements)]
        if words != ANY:
            tests.append(reduce(Column.__or__, [of_value.contains(w[6:]) if w.startswith("value:") else anywhere.contains(w) for w in words]))
        return reduce(Column.__and__, tests)

    tags = [F.when(fits(*conditions), tag) for *conditions, tag in EFFECTS]
    tags.append(F.when(F.size(ips_in(F.coalesce(value, F.lit("")), True)) > 0, "private-ip-leak"))
    return F.array_distinct(F.array_compact(F.array(*tags)))


def item_header(tag: Column, label: Column) -> Column:
    """The header a change is about: the one its label ends with, or the one its tag always concerns; else null."""
    after = F.trim(F.substring_index(label, ":", -1))
    labelled = label.startswith("header ") & F.contains(label, F.lit(":")) & (after != "")
    fixed = F.create_map(*[F.lit(x) for pair in HEADER_OF.items() for x in pair])
    return F.when(labelled, canonical(after)).otherwise(F.try_element_at(fixed, tag))


def with_expected(rules: DataFrame) -> DataFrame:
    cond = F.array_join(F.transform(F.coalesce("conditions", F.array().cast("array<struct<element:string,comparison:string,value:string>>")), lambda c: F.coalesce(c["value"], F.lit(""))), " ")
    return rules.withColumn(
        "expected",
        expected_tags(F.col("target_header"), F.col("target_element"), F.col("operation"), F.col("value"), cond),
    )


def rules_vs_changes(rules: DataFrame, items: DataFrame, call: str = "call_no", tags: Sequence[str] = MANIP_TAGS) -> DataFrame:
    """Three verdicts: observed-as-configured, configured-not-observed, observed-not-configured.

    ``rules``: rule_id, header, expected ARRAY<tag>. ``items``: tag, header (null when not about one)
    and the call. Calls with the same kinds of change (tag, header) are counted together, and rules that
    expect the same are answered together, so the changes are read once and joined with no rule: the
    joins see kinds of calls and kinds of rules.
    """
    per_call = items.groupBy(call).agg(F.sort_array(F.collect_set(F.struct("tag", "header"))).alias("kinds"))
    profiles = per_call.groupBy("kinds").agg(F.count(call).alias("n_calls"))
    # the running number must be the same for all readers
    profiles = stage(profiles.withColumn("profile", F.monotonically_increasing_id()), "call-profiles")
    members = profiles.select("profile", "n_calls", F.explode("kinds").alias("k")).select("profile", "n_calls", "k.*")
    kinds = members.groupBy("tag", "header").agg(F.sum("n_calls").alias("n_calls"))
    wanted = rules.select("rule_id", F.lower("header").alias("rule_header"), F.explode("expected").alias("tag"))
    wanted = wanted.groupBy("rule_id").agg(F.sort_array(F.collect_set(F.struct("tag", "rule_header"))).alias("want"))
    wants = wanted.select("want").distinct().select("want", F.explode("want").alias("w")).select("want", "w.*")
    fits = F.col("header").isNull() | (F.col("header") == F.col("rule_header"))
    explained = wants.join(kinds.drop("n_calls"), "tag").where(fits).select("want", "tag", "header").distinct()
    # a call counts once, however many of its changes are expected
    seen = join_null_safe(explained, members, ["tag", "header"], "inner").groupBy("want", "profile", "n_calls").agg(F.collect_set("tag").alias("tags"))
    per_want = seen.groupBy("want").agg(
        F.sum("n_calls").alias("n_calls"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags")
    )
    per_rule = wanted.join(per_want, "want")
    observed = per_rule.select(F.col("rule_id"), F.lit("observed-as-configured").alias("verdict"), "n_calls", F.array_join("tags", ",").alias("tags"), F.lit(None).cast("string").alias("header"))
    missing = rules.select("rule_id").join(per_rule.select("rule_id"), "rule_id", "left_anti").select(
        "rule_id", F.lit("configured-not-observed").alias("verdict"), F.lit(0).cast("bigint").alias("n_calls"), F.lit("").alias("tags"), F.lit(None).cast("string").alias("header")
    )
    left = join_null_safe(kinds.where(F.col("tag").isin(list(tags))), explained.select("tag", "header").distinct(), ["tag", "header"], "left_anti")
    rest = left.select(
        F.lit(None).cast("string").alias("rule_id"), F.lit("observed-not-configured").alias("verdict"), "n_calls", F.col("tag").alias("tags"), "header"
    )
    return observed.unionByName(missing).unionByName(rest)


def _two_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the two rules that come first, as (a, b): one to compare with, and a spare for itself."""
    top = top_per(df, keys, [F.col("ord"), F.col("rule_id")], 2)
    me = F.struct("ord", "rule_id", "operation")
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, me)).alias("a"), F.max(F.when(F.col("rank") == 2, me)).alias("b")
    )


def write_conflicts(rules: DataFrame) -> DataFrame:
    """Rules that write a target another rule of the set also writes for messages in common: each
    with the first such rule.

    Instead of comparing rules pairwise, each rule enters the groups in which others look for it
    (message type or any, each method or any, adds and the rest apart), each group keeps its two
    first rules, and a rule looks into the groups it overlaps. Rules that agree in target, type,
    methods and adding enter and look alike, so they do both once: only their two first rules
    enter, and what they find is shared. Linear in rules plus kinds of rules times methods.
    """
    r = rules.where(F.col("operation").isin(WRITE_OPS)).select(
        "rule_id", "set_name", "ord", "operation", canonical(F.col("target_header")).alias("h"),
        F.coalesce("target_element", F.lit("")).alias("el"), F.coalesce("msg_type", F.lit("any")).alias("ty"),
        F.coalesce("methods", F.array().cast("array<string>")).alias("ms"), (F.col("operation") == "add").alias("adds"),
    ).where(F.col("set_name").isNotNull() & F.col("h").isNotNull())
    alike = ["set_name", "h", "el", "ty", "ms", "adds"]
    # one copy of the rules' own rows, and no sort of their copies: read again below
    firsts = stage(_two_first(r.select(*alike, "ord", "rule_id", "operation").distinct(), alike), "rule-kinds")
    some = F.size("ms") > 0
    offered = (
        firsts.select(*alike, F.explode(F.array_compact(F.array("a", "b"))).alias("o")).select(*alike, "o.*")
        .withColumn("ty_k", F.explode(F.array(F.concat(F.lit("="), F.col("ty")), F.lit("*"))))
        .withColumn("m_k", F.explode(F.concat(F.when(some, F.transform("ms", lambda m: F.concat(F.lit("="), m))).otherwise(F.array(F.lit("=any"))), F.array(F.lit("*")))))
        .withColumn("add_k", F.explode(F.array(F.when(F.col("adds"), "add").otherwise("other"), F.lit("*"))))
    )
    keys = ["set_name", "h", "el", "ty_k", "m_k", "add_k"]
    heads = _two_first(offered.select(*keys, "ord", "rule_id", "operation").distinct(), keys)
    looks = (
        firsts.select(*alike)
        .withColumn("ty_k", F.explode(F.when(F.col("ty") == "any", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), F.col("ty")), F.lit("=any")))))
        .withColumn("m_k", F.explode(F.when(some, F.concat(F.transform("ms", lambda m: F.concat(F.lit("="), m)), F.array(F.lit("=any")))).otherwise(F.array(F.lit("*")))))
        .withColumn("add_k", F.when(F.col("adds"), "other").otherwise("*"))
    )
    # at most two heads per method of the rule and two more
    found = looks.join(heads, keys).groupBy(*alike).agg(F.collect_set(F.struct("a", "b")).alias("heads"))
    other = F.transform("heads", lambda x: F.when(x["a"]["rule_id"] != F.col("rule_id"), x["a"]).otherwise(x["b"]))
    met = r.join(found, alike).select("set_name", "rule_id", "ord", "operation", F.array_min(other).alias("o"))
    first = met.where(F.col("o").isNotNull()).groupBy("set_name", "rule_id", "ord", "operation").agg(F.min("o").alias("o"))
    return first.select(
        "set_name", "rule_id", F.lit("write-conflict").alias("kind"), F.col("o.rule_id").alias("other_id"),
        F.when((F.col("operation") == "delete") | (F.col("o.operation") == "delete"), "warn").otherwise("notice").alias("severity"),
        (F.col("o.ord") > F.col("ord")).alias("other_wins"),
    )


def delete_then_add(rules: DataFrame) -> DataFrame:
    """Rules of a set that delete and add one header: each with the first of the opposite kind."""
    r = rules.where(F.col("operation").isin("add", "delete")).withColumn("h", canonical(F.col("target_header")))
    firsts = r.groupBy("set_name", "h", F.when(F.col("operation") == "add", "delete").otherwise("add").alias("operation")).agg(
        F.min_by("rule_id", F.struct("ord", "rule_id")).alias("other_id")
    )
    return r.join(firsts, ["set_name", "h", "operation"]).select(
        "set_name", "rule_id", F.lit("delete-then-add").alias("kind"), "other_id", F.lit("notice").alias("severity")
    )


def store_references(rules: DataFrame) -> DataFrame:
    """Stored values that nobody stores, that are stored later in the set, or stored but never read."""
    names = F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    ignore = ["original", "remainder", "null", "header", "true", "false", "self", "any", "value"]
    refs = rules.select("rule_id", "set_name", "ord", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("ref")).where(~F.col("ref").isin(ignore))
    stores = rules.where(F.col("operation") == "store").select(F.lower("name").alias("ref"), "rule_id", "set_name", "ord", F.lit("store").alias("operation"))
    heads = _two_first(stores, ["ref"])
    met = refs.join(heads, "ref", "left").withColumn("o", F.when(F.col("a.rule_id") != F.col("rule_id"), F.col("a")).otherwise(F.col("b")))
    same_set = met.join(stores.groupBy("ref", "set_name").agg(F.min("ord").alias("set_ord")), ["ref", "set_name"], "left")
    reads = same_set.select(
        "set_name", "rule_id", "ref", F.col("o.rule_id").alias("other_id"),
        F.when(F.col("o").isNull(), "never-stored").when(F.col("set_ord") > F.col("ord"), "stored-later").when(F.col("set_ord").isNull(), "other-set").alias("kind"),
    ).where(F.col("kind").isNotNull())
    unread = stores.join(refs.select("ref").distinct(), "ref", "left_anti").select(
        "set_name", "rule_id", "ref", F.lit(None).cast("string").alias("other_id"), F.lit("never-read").alias("kind")
    )
    return reads.unionByName(unread)


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """All conflicts of a rule table: set_name, rule_id, kind, other_id, severity."""
    store = store_references(rules).withColumn("severity", F.when(F.col("kind").isin("never-stored", "stored-later"), "crit").otherwise("notice"))
    cols = ["set_name", "rule_id", "kind", "other_id", "severity"]
    return write_conflicts(rules).select(*cols).unionByName(delete_then_add(rules).select(*cols)).unionByName(store.select(*cols))
