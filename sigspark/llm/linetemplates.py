"""Line dedup by literal repeats and a log-template tree.

Lines are cut into tokens. A line is boilerplate, and dropped everywhere, by any of three laws; texts are different by content:

* literal: the line stands as it is, but for white space, in ``min_texts`` different texts and has at least ``literal_tokens`` tokens;
* long: so it stands in ``long_texts`` different texts and has at least ``long_tokens`` tokens;
* template: it has at least ``min_tokens`` tokens, and its template stands in ``min_texts`` different texts and has constants
  for at least ``min_constant`` of its tokens.

For templates, tokens with digits, ``@`` or ``://`` are variable fields at sight. The tree has a fixed depth: a line goes to the leaf of
its token count and its leading tokens. In a leaf, a token that ``min_texts`` different texts have at a place is a constant of that place,
any other is a variable field; a line's template is what remains. A text counts once for a line, a constant or a template,
however many of its lines have it.

Lines are cut once, into a table; all counts read it. Distinct lines are counted before anything is shuffled by leaf, so a line
that every document has is a row per task. Different texts are counted one by one only where the sum over the lines and the
most of one line don't tell.

Cases: null texts have no lines and stay; lines without tokens stay; by default lines of fewer than ``min_tokens`` tokens stay, too,
unless ``literal_tokens`` is given; equal texts count once; equal rows each get a row; a text that loses all lines stays as the empty
text; an empty table gives an empty result; other columns stay, clashing ones (``n_lines``, ``n_dropped``, ``kept_text``) as ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import set_aside
from sigspark.session import BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT, int_conf, stage

DEPTH, MIN_TEXTS, MIN_CONSTANT, MIN_TOKENS = 3, 10, 0.6, 4
# Two texts that share a long line are mostly near copies; dropped in both, the line would be lost.
LONG_TOKENS, LONG_TEXTS = 50, 3
FIELD = "<*>"
OWN = ["n_lines", "n_dropped", "kept_text"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def literal(line: Column) -> Column:
    """The line's tokens, one space between them.

    Most lines need no rewriting: a search, which copies nothing, comes before each replacement.
    """
    wide = line.rlike(r"[\t\x0b\f\r]| {2}|^ | $")
    return F.when(wide, F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"^ | $", "")).otherwise(line)


def masked(one: Column) -> Column:
    """A literal line with tokens with digits, ``@`` or ``://`` as a field."""
    fields = one.rlike(r"[0-9@]|://")
    return F.when(fields, F.regexp_replace(one, r"[^ ]*(?:[0-9@]|://)[^ ]*", FIELD)).otherwise(one)


def leaf(line: Column, tokens: Column, depth: int) -> Column:
    return F.xxhash64(tokens, F.substring_index(line, " ", depth))


def _if_small(df: DataFrame, name: str) -> DataFrame:
    """The staged table, broadcast where it was counted to be small; else it meets the lines in a shuffled join."""
    kept = stage(df, name)
    return F.broadcast(kept) if kept.count() <= int_conf(df.sparkSession, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT) else kept


def _text_hash(text: str) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def line_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """id, th (hash of the text), lit, tokens, line (masked), line_hash, leaf: the different lines with tokens of each row's text."""
    each = docs.select(F.col(doc_id).alias("id"), _text_hash(text).alias("th"), F.explode(F.array_distinct(lines(F.col(text)))).alias("raw"))
    each = each.select("id", "th", literal(F.col("raw")).alias("one")).where("one != ''")
    each = each.select("id", "th", F.xxhash64("one").alias("lit"), masked(F.col("one")).alias("line"))
    each = each.withColumn("tokens", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return stage(each.select("*", F.xxhash64("line").alias("line_hash"), leaf(F.col("line"), F.col("tokens"), depth).alias("leaf")), "line-rows")


def repeats(each: DataFrame, min_texts: int = MIN_TEXTS, literal_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS, long_texts: int = LONG_TEXTS) -> DataFrame:
    """lit, n_texts: the lines that recur literally in enough different texts."""
    least = F.when(F.col("tokens") >= long_tokens, min(long_texts, min_texts)).otherwise(min_texts)
    # rows of copies count here, so this is the most that there can be
    often = each.where(F.col("tokens") >= min(literal_tokens, long_tokens)).groupBy("lit", "tokens").count()
    often = often.where(((F.col("tokens") >= literal_tokens) & (F.col("count") >= min_texts)) | ((F.col("tokens") >= long_tokens) & (F.col("count") >= least)))
    met = each.select("lit", "th").join(_if_small(often.select("lit", least.alias("least")), "often"), "lit").distinct()
    return met.groupBy("lit", "least").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts >= least").select("lit", "n_texts")


def templates(each: DataFrame, min_texts: int = MIN_TEXTS, min_constant: float = MIN_CONSTANT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """line_hash (of a masked line to drop), template, n_texts (different texts with that template)."""
    rows = each.where(F.col("tokens") >= min_tokens)
    busy = _if_small(rows.groupBy("leaf").count().where(F.col("count") >= min_texts).select("leaf"), "leaves")
    # copies of a text share its hash: one row per text and line, then one row per line with the texts that have it
    pairs = stage(rows.join(busy, "leaf", "left_semi").select("leaf", "line_hash", "line", "th").distinct(), "pairs")
    known = stage(pairs.groupBy("leaf", "line_hash", "line").agg(F.count(F.lit(1)).alias("texts")), "lines")
    tokens = known.select("leaf", "line_hash", "texts", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    place = ["leaf", "pos", "token"]
    # a text may have several of the lines: the sum is the most texts there can be, the largest the fewest
    summed = stage(tokens.where(F.col("token") != FIELD).groupBy(*place).agg(F.sum("texts").alias("most"), F.max("texts").alias("fewest")).where(F.col("most") >= min_texts), "places")
    open_ = _if_small(summed.where(F.col("fewest") < min_texts).select(*place), "open-places")
    asked = tokens.join(open_, place, "left_semi").select(*place, "line_hash")
    counted = pairs.select("leaf", "line_hash", "th").join(asked, ["leaf", "line_hash"]).select(*place, "th").distinct().groupBy(*place).count()
    constant = summed.where(F.col("fewest") >= min_texts).select(*place).union(counted.where(F.col("count") >= min_texts).select(*place))
    constant = _if_small(constant.withColumn("fixed", F.lit(1)), "constants")
    marked = tokens.join(constant, place, "left")
    word = F.when(F.col("fixed") == 1, F.col("token")).otherwise(FIELD)
    made = marked.groupBy("line_hash", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("pos", word.alias("word")))).alias("w"), F.avg(F.coalesce("fixed", F.lit(0))).alias("share")
    )
    made = made.where(F.col("share") >= min_constant).select("leaf", "line_hash", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("template"))
    made = _if_small(made.withColumn("t", F.xxhash64("leaf", "template")), "made")
    texts = pairs.select("leaf", "line_hash", "th").join(made.select("leaf", "line_hash", "t"), ["leaf", "line_hash"]).select("t", "th").distinct()
    recurring = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= min_texts)
    return made.join(recurring, "t").select("line_hash", "template", "n_texts")


def drop_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_texts: int = MIN_TEXTS, min_constant: float = MIN_CONSTANT, min_tokens: int = MIN_TOKENS, depth: int = DEPTH,
    literal_tokens: int | None = None, long_tokens: int = LONG_TOKENS, long_texts: int = LONG_TEXTS,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (the text without recurring lines); ``literal_tokens`` is ``min_tokens`` if not given."""
    rows = set_aside(docs, OWN)
    each = line_rows(rows, text, doc_id, depth)
    bad = _if_small(templates(each, min_texts, min_constant, min_tokens).select("line_hash").distinct(), "templates")
    again = _if_small(repeats(each, min_texts, min_tokens if literal_tokens is None else literal_tokens, long_tokens, long_texts).select("lit"), "repeats")
    found = each.select("id", "th", "lit", "line_hash").join(bad.withColumn("_t", F.lit(1)), "line_hash", "left").join(again.withColumn("_l", F.lit(1)), "lit", "left")
    hit = found.where("_t = 1 OR _l = 1").groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("lit").alias("_bad"))
    keyed = rows.withColumn("_row_th", _text_hash(text))
    out = keyed.join(hit, keyed[doc_id].eqNullSafe(hit["_id"]) & (keyed["_row_th"] == hit["_th"]), "left")
    all_ = lines(F.col(text))
    kept = F.filter(all_, lambda x: ~F.coalesce(F.array_contains("_bad", F.xxhash64(literal(x))), F.lit(False)))
    kept = F.when(F.col("_bad").isNull(), all_).otherwise(kept)
    out = out.withColumn("_kept", kept)
    return out.select(
        *rows.columns,
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_)).alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_) - F.size("_kept")).alias("n_dropped"),
        F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")).alias("kept_text"),
    )
