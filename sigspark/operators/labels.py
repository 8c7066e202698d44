"""Labels of texts from a table of rules, all rules looked up in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators.matching import match_containment


@dataclass(frozen=True)
class LabelRule:
    """A text has the label if it holds the anchor, whatever its case, and fits the pattern, if there is one.

    The anchor is a literal that every text of the pattern holds.
    """

    label: str
    anchor: str
    pattern: str | None = None


def rule_table(spark, rules: Sequence[LabelRule]) -> DataFrame:
    rows = [(r.label, r.anchor, r.pattern) for r in rules]
    return spark.createDataFrame(rows, "label string, anchor string, pattern string")


def label_texts(texts: DataFrame, rules: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, label): the labels of each key's texts; ``rules`` has label, anchor, pattern.

    Only distinct texts are read, however often a text occurs. The anchors of all rules are looked for at once; patterns are tried
    only on texts that hold their anchor. Null texts have no label; an empty anchor fits nothing.
    """
    keys = list(keys)
    said = texts.select(*keys, F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    asked = rules.select("label", F.lower("anchor").alias("_anchor"), "pattern").distinct()
    everywhere = F.lit(0).alias("capture_id")
    found = match_containment(asked.select(everywhere, "_anchor"), said.select(everywhere, "_text"), "_anchor", "_text").drop("capture_id")
    fits = F.col("pattern").isNull() | F.regexp_like("_text", F.concat(F.lit("(?i)"), F.col("pattern")))
    named = found.join(asked, "_anchor").where(fits).select("_text", "label").distinct()
    return said.join(named, "_text").select(*keys, "label").distinct()
