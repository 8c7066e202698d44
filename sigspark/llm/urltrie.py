"""URL rules in a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host and all subdomains when the url's path starts with the rule's. The trie has
the host labels from the right, then, under a mark that ends the host, the path cut after each ``/``; the last
piece of a rule's path may be a mere beginning of a segment. Walking it yields every fitting rule; the longest wins: most host
labels, then longest path. Rules equal in both are settled as block over allow.

The trie is broadcast to the tasks while there are at most ``MAX_BROADCAST_RULES`` rules (the caller counts them);
beyond that, urls and rules meet in an equi-join on (host suffix, path beginning), with the same results.

Cases: null urls and urls without ``://`` have an empty host and path and fit no rule; a rule with an empty host
fits every url that has a host; no rule: the default verdict, rule null; repeated rows each get a row; an empty table gives
an empty result; the other input columns stay, clashing ones (``host``, ``path``, ``rule``, ``verdict``) as ``<name>_in``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sigspark.llm.common import ascii_lower, set_aside

MAX_BROADCAST_RULES = 1_000_000
OWN = ["host", "path", "rule", "verdict"]
Rule = tuple[str, str, str]  # host, path, verdict

# Keys of a node besides labels and segments: the child where the path begins, rules that end here, beginnings of a segment.
PATH, ENDS, HEADS = 0, 1, 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: str) -> list[str]:
    return host.split(".")[::-1] if host else []


def pieces(path: str) -> list[str]:
    """The path cut after each slash: ``/en/x`` gives ``/``, ``en/``, ``x``."""
    cut = path.split("/")
    return [p + "/" for p in cut[:-1]] + ([cut[-1]] if cut[-1] else [])


def stronger(a: Rule | None, b: Rule) -> Rule:
    return b if a is None or b[2] == "block" else a


def build(rules: Sequence[Rule]) -> dict:
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in labels(host):
            node = node.setdefault(label, {})
        node = node.setdefault(PATH, {})
        cut = pieces(path)
        whole, head = (cut, None) if not cut or cut[-1].endswith("/") else (cut[:-1], cut[-1])
        for piece in whole:
            node = node.setdefault(piece, {})
        if head is None:
            node[ENDS] = stronger(node.get(ENDS), (host, path, verdict))
        else:
            heads = node.setdefault(HEADS, {})
            heads[head] = stronger(heads.get(head), (host, path, verdict))
    return root


def _path_rule(at: dict | None, cut: list[str]) -> Rule | None:
    """The rule with the longest path below the node ``at`` that ``cut`` starts with."""
    here = None
    for piece in [*cut, ""]:
        if at is None:
            break
        here = at.get(ENDS, here)
        heads = at.get(HEADS, {})
        for n in range(1, len(piece) + 1) if heads else ():
            here = heads.get(piece[:n], here)
        at = at.get(piece)
    return here


def longest(root: dict, host: str, path: str) -> Rule | None:
    """The winning rule: the deepest host node whose paths fit, there the longest path."""
    if not host:
        return None
    best, node, cut = None, root, pieces(path)
    for label in [None, *labels(host)]:
        node = node if label is None else node.get(label)
        if node is None:
            break
        best = _path_rule(node.get(PATH), cut) or best
    return best


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, the winning rule (host + path) and the verdict."""
    spark = pages.sparkSession
    kept = set_aside(pages, OWN)
    rows = kept.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if len(rules) > max_broadcast:
        table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
        return by_join(rows, table, default)
    trie = spark.sparkContext.broadcast(build(rules))  # at most max_broadcast rules
    schema = StructType([*rows.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            won = [longest(root, h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([w and w[0] + w[1] for w in won], pa.string())
            verdict = pa.array([w[2] if w else default for w in won], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(walk, schema)


def by_join(rows: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule tables of any size: one look-up per (host suffix, path beginning that some rule's length has).

    ``rows`` has host and path; addresses are short, so the keys of one stay few. Distinct (host, path) are looked up once.
    """
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
    hosts = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(hosts)), lambda i: F.array_join(F.slice(hosts, -i, i), ".")))
    begins = F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda i: F.col("path").substr(F.lit(1), i))
    places = rows.where("host != ''").select("host", "path").distinct()
    keys = places.select("host", "path", F.posexplode(suffixes).alias("depth", "_h")).select("*", F.explode(begins).alias("_p"))
    table = one.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict")
    won = keys.join(table, ["_h", "_p"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), "verdict"), F.struct("depth", F.char_length("_p"))).alias("won")
    )
    out = rows.join(won, ["host", "path"], "left")
    cols = [rows[c] for c in rows.columns]
    return out.select(*cols, F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"))

