"""Benchmark decontamination with DataFrame operations alone.

Texts are lower-cased (A-Z) and cut into words; a benchmark item's windows are its runs of ten words (an item with fewer
words is one window). The distinct windows form a hash set that is broadcast while it has at most ``MAX_BROADCAST_WINDOWS``
windows (counted first), and met by a shuffled hash-keyed join beyond that. Every word position of a document
proposes one window per length in use; equal hashes are verified word by word. Positions never leave the scan unless
they hit.

Cases: null text and text without words: no words, no hits; items without words have no windows; an item that occurs
several times counts once per item_id; null item_ids take part in hits but are not counted or listed; equal rows
each get their row; an empty benchmark hits nothing; an empty table gives an empty result; other columns are read by
``clean`` only, where they stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import ascii_lower
from sigspark.plans.slices import join_null_safe

WINDOW = 10
MAX_BROADCAST_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text; null text has none."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: n (words), window (array), h (hash), items (ids of the items that have it)."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(size), F.size("w"))
    each = w.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    cut = each.select("item_id", "n", F.slice("w", F.col("i"), F.col("n")).alias("window"))
    return cut.groupBy("n", "window").agg(F.collect_set("item_id").alias("items")).withColumn("h", F.xxhash64("window"))


def _found_type(benchmark: DataFrame) -> str:
    """Hit windows of a row, with item ids of whatever type they have."""
    return f"array<struct<pos:int,n:int,items:array<{benchmark.schema['item_id'].dataType.simpleString()}>>>"


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, found (array of pos, n, items; one per hit window)."""
    known = windows(benchmark, size)
    bounds = known.groupBy("n").count().collect()  # one row per window length, at most ``size``
    lengths = sorted(r["n"] for r in bounds)
    table = known.select(F.col("n").alias("_n"), F.col("window").alias("_window"), F.col("h").alias("_h"), "items")
    if sum(r["count"] for r in bounds) <= max_broadcast:
        table = F.broadcast(table)
    text = F.col("text")
    base = docs.select("doc_id", F.xxhash64("text", F.octet_length(text)).alias("text_hash"), words(text).alias("w"))
    if not lengths:
        return base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.lit(None).cast(_found_type(benchmark)).alias("found"))
    k = len(lengths)
    # place -1 stands for the row itself and survives without a hit; place i is word i div k with the length i mod k
    places = base.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("w") * k - 1)).alias("i"))
    pos = F.floor(F.col("i") / k).cast("int") if k > 1 else F.col("i")
    n = F.element_at(F.array(*map(F.lit, lengths)), F.pmod(F.col("i"), F.lit(k)) + 1) if k > 1 else F.lit(lengths[0])
    tried = places.where((F.col("i") < 0) | (pos + n <= F.col("n_words")))
    tried = tried.select("doc_id", "text_hash", "n_words", "i", pos.alias("pos"), n.alias("n"), F.when(F.col("i") >= 0, F.slice("w", pos + 1, n)).alias("window"))
    tried = tried.withColumn("h", F.when(F.col("i") >= 0, F.xxhash64("window")))
    met = tried.join(table, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & (F.col("window") == F.col("_window")), "left")
    met = met.where(F.col("_h").isNotNull() | (F.col("i") < 0))
    hit = F.when(F.col("i") >= 0, F.struct("pos", "n", "items"))
    per = met.groupBy("doc_id", "text_hash", "n_words").agg(F.collect_set(hit).alias("found"), F.count(F.when(F.col("i") < 0, 1)).alias("copies"))
    # rows with the same id and text are one group; each gets its row back
    rows = per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "text_hash", "n_words", "found")


def covered(found: Column) -> Column:
    """Number of words inside at least one of the hit windows."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["pos"]))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(found), start, step, lambda a: a["total"])


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    per = hits(docs, benchmark, size, max_broadcast)
    found = F.coalesce("found", F.array().cast(_found_type(benchmark)))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"]))), lambda i: i.cast("string")))
    out = per.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered(found).alias("n_hit"), items.alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, drop: str = "documents", size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or (``drop="spans"``) with the hit words and what stands before each cut out."""
    per = hits(docs.select("doc_id", "text"), benchmark, size, max_broadcast)
    bad = per.where(F.size("found") > 0).groupBy("doc_id", "text_hash").agg(F.first("found").alias("_found"))
    if drop == "documents":
        bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_th"))
        th = F.xxhash64(docs["text"], F.octet_length(docs["text"]))
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (th == bad["_bad_th"]), "left_anti")
    keyed = docs.withColumn("_th", F.xxhash64("text", F.octet_length("text")))
    bad = bad.withColumnRenamed("text_hash", "_th")
    joined = join_null_safe(keyed, bad, ["doc_id", "_th"])
    parts = F.regexp_extract_all("text", F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    kept = F.filter(parts, lambda p, i: ~F.exists("_found", lambda x: (x["pos"] <= i) & (i < x["pos"] + x["n"])))
    cut = F.concat(F.array_join(kept, ""), tail)
    return joined.withColumn("text", F.when(F.size("_found") > 0, cut).otherwise(F.col("text"))).select(*docs.columns)
