"""Text retrieval: sections, chunks, tokens, inverted index, BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.plans.slices import top_per
from sigspark.session import BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT, int_conf, stage

# Words too common to tell passages apart: articles, pronouns, auxiliaries, prepositions, conjunctions.
STOPWORDS = (
    "a an the this that these those some any no each every all both i me my we us our you your he him his she her it its they them their "
    "am is are was were be been being do does did has have had will would can could may might shall should must "
    "of in on at by to from for with without as about into over under after before between through and or but nor if than then so "
    "not only very too also there here when where which who whom what how"
).split()
TOKEN = "[a-z0-9_À-ɏ]+"
K1, B, HEADING_BOOST, MIN_SCORE_RATIO = 1.2, 0.75, 0.5, 0.08
# Characters of a chunk, of the piece of the chunk before it that it repeats, and of the largest piece that is not cut.
CHUNK, OVERLAP, PIECE = 1000, 150, 300

# What makes a line a heading (group 1 of the first three is its text).
HASHES = r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t#]*$"
BRACKETS = r"^\s*\[([^\[\]]+)\]\s*$"
RULER = r"^ {0,3}(?:={3,}|-{3,}|~{3,}|_{3,})\s*$"
NUMBERED = r"^\s*\d{1,3}(?:\.\d{1,3})*[.):]?\s+[A-Za-z(]"
TITLE_WORDS, TITLE_CHARS = 12, 100


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case word tokens in order, whole; stopwords and lone letters dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]$")) & ~t.isin(list(stopwords)))


def split_pages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Form-feed pages of documents, numbered from 1, blank pages dropped."""
    pages = docs.select(F.col(doc_id), F.posexplode(F.split(F.col(text), "\f")).alias("_p", "text"))
    return pages.where(F.trim("text") != "").select(doc_id, (F.col("_p") + 1).alias("page"), "text")


def heading_lines(pages: DataFrame, row: str, text: str, atx: bool = True) -> DataFrame:
    """One row per line of each page that is not blank or is body: row, pos, line, heading (null for body), blank.

    A line is a heading by hash marks, brackets, a ruler under it, a number before a few words, or capitals alone.
    """
    lines = pages.select(row, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)).alias("pos", "line"))
    page = Window.partitionBy(row).orderBy("pos")
    bare = F.trim(F.regexp_replace("line", r"\s+", " "))
    few = (F.length(bare) <= TITLE_CHARS) & (F.size(F.split(bare, " ")) <= TITLE_WORDS)
    letters = F.length(F.regexp_replace("line", r"[^A-Za-z]", ""))
    shouted = (bare == F.upper(bare)) & F.col("line").rlike("[A-Z]{3}") & (letters / F.greatest(F.length(bare), F.lit(1)) >= 0.5) & ~F.col("line").rlike("[=;|<>{}]")
    told = lines.withColumn("ruled", F.coalesce(F.lead("line").over(page), F.lit("")).rlike(RULER) & (letters > 0) & (F.length(bare) <= TITLE_CHARS))
    told = told.withColumn("ruler", F.col("line").rlike(RULER) & F.coalesce(F.lag("ruled").over(page), F.lit(False)))
    heading = (
        F.when(F.lit(atx) & F.col("line").rlike(HASHES), F.regexp_extract("line", HASHES, 1))
        .when(F.col("line").rlike(BRACKETS), F.regexp_extract("line", BRACKETS, 1))
        .when(F.col("ruled"), bare)
        .when(F.col("line").rlike(NUMBERED) & few & ~bare.rlike("[.,;]$"), bare)
        .when(shouted & few & (F.length(bare) >= 3), F.regexp_replace(bare, r"[:\s]+$", ""))
    )
    return told.where(~F.col("ruler")).select(row, "pos", "line", F.nullif(F.trim(heading), F.lit("")).alias("heading"), (bare == "").alias("blank"))


def headed_sections(pages: DataFrame, row: str, text: str, atx: bool = True) -> DataFrame:
    """row, section (from 0), heading, body: a section begins with each run of headings, of which the last two name it.

    A page without any body is one section of its whole text: headings alone are not lost.
    """
    lines = heading_lines(pages, row, text, atx)
    page = Window.partitionBy(row).orderBy("pos")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    is_heading = F.col("heading").isNotNull()
    earlier = F.last(F.when(~F.col("blank"), is_heading), ignorenulls=True).over(before)
    starts = lines.withColumn("first", (is_heading & ~F.coalesce(earlier, F.lit(False))).cast("int"))
    numbered = starts.withColumn("no", F.sum("first").over(page))
    names = F.transform(F.array_sort(F.collect_list(F.when(is_heading, F.struct("pos", "heading")))), lambda x: x["heading"])
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_heading, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    made = numbered.groupBy(row, "no").agg(names.alias("names"), F.regexp_replace(text_of, r"^\s+|\s+$", "").alias("body"))
    made = made.where(F.col("body") != "")
    last_two = F.slice("names", F.greatest(F.lit(1), F.size("names") - 1), F.lit(2))
    # read twice below
    made = stage(made.select(row, "no", F.when(F.size("names") > 0, F.array_join(last_two, " > ")).alias("heading"), "body"), "sections")
    bare = pages.select(row, F.regexp_replace(text, r"^\s+|\s+$", "").alias("body")).where(F.col("body") != "").join(made.select(row), row, "left_anti")
    both = made.unionByName(bare.select(row, F.lit(0).cast("long").alias("no"), F.lit(None).cast("string").alias("heading"), "body"))
    return both.select(row, (F.row_number().over(Window.partitionBy(row).orderBy("no")) - 1).alias("section"), "heading", "body")


def chunks(sections_: DataFrame, keys: Sequence[str], size: int = CHUNK, overlap: int = OVERLAP, piece: int = PIECE) -> DataFrame:
    """keys, heading, part (from 0), body: the body cut at sentences into chunks of about ``size`` characters.

    A sentence, or a piece of at most ``piece`` characters of a longer one, goes to the chunk that its first character falls
    into when the body is cut every ``size`` characters. A chunk begins with the end of the one before, from a word's start.
    """
    keys = list(keys)
    sentence = r"(?s)[^.!?\n]*[.!?]+[\"')\]]*\s*|[^.!?\n]+\n*\s*|\s+"
    fitting = rf"(?s).{{1,{piece}}}(?:\s+|$)|.{{1,{piece}}}"
    found = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(sentence), F.lit(0)), lambda s: F.regexp_extract_all(s, F.lit(fitting), F.lit(0))))
    each = sections_.select(*keys, "heading", F.posexplode(found).alias("pos", "piece"))
    section = Window.partitionBy(*keys).orderBy("pos")
    start = F.coalesce(F.sum(F.length("piece")).over(section.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("cut", F.floor(start / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    made = placed.groupBy(*keys, "heading", "cut").agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("own")).where(F.col("own") != "")
    order = Window.partitionBy(*keys).orderBy("cut")
    tail = F.regexp_extract(F.lag("own").over(order), rf"(?s)(?:^|\s)(\S.{{0,{overlap - 1}}})$", 1)
    told = made.withColumn("tail", F.coalesce(tail, F.lit(""))).withColumn("part", F.row_number().over(order) - 1)
    return told.select(*keys, "heading", "part", F.when(F.col("tail") != "", F.concat_ws("\n", "tail", "own")).otherwise(F.col("own")).alias("body"))


def sections(pages: DataFrame, doc_id: str, text: str = "text", page: str | None = None, atx: bool = True) -> DataFrame:
    """Pages to headed sections and their chunks, one row per chunk: keys, section, chunk (from 0 in the page), heading, body.

    ``doc_id`` and ``page`` name a page. The lines of a page meet in one task, pages spread over the cluster.
    """
    keys = [doc_id] + ([page] if page else [])
    # rows with the same keys are pages of their own: a running number tells them apart, written once so that all readers see the same
    rows = stage(pages.select(F.struct(*keys, F.monotonically_increasing_id().alias("_row")).alias("_page"), F.col(text).alias("_text")), "pages")
    cut = chunks(headed_sections(rows, "_page", "_text", atx), ["_page", "section"])
    number = F.row_number().over(Window.partitionBy("_page").orderBy("section", "part")) - 1
    return cut.withColumn("chunk", number).select(*[F.col("_page")[k].alias(k) for k in keys], "section", "chunk", "heading", "body")


def term_rows(df: DataFrame, keys: Sequence[str], text: Column, out: str = "term") -> DataFrame:
    """One row per token: the rules of ``tokens``, applied after the explode in compiled code."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = df.select(*keys, F.explode(found).alias(out))
    return rows.where(((F.length(out) > 1) | F.col(out).rlike("^[0-9]$")) & ~F.col(out).isin(STOPWORDS))


def build_index(texts: DataFrame, chunk_key: Sequence[str], text: Column, heading: Column | None = None) -> dict[str, DataFrame]:
    """postings(key, term, tf, in_heading), lengths(key, dl), df(term, df), totals(n, avgdl).

    The texts are cut once and the postings written to the shared folder; the other parts are
    aggregates of them. Kept for good, postings would be bucketed by term.
    """
    key = list(chunk_key)
    postings = term_rows(texts, key, text).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    if heading is None:
        postings = postings.withColumn("in_heading", F.lit(0))
    else:
        heads = term_rows(texts, key, heading).distinct().withColumn("in_heading", F.lit(1))
        postings = postings.join(heads, [*key, "term"], "left").withColumn("in_heading", F.coalesce("in_heading", F.lit(0)))
    postings = stage(postings, "postings")
    lengths = postings.groupBy(*key).agg(F.sum("tf").alias("dl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    totals = postings.agg((F.sum("tf") / n.select("n").scalar()).alias("avgdl"), F.first(n.select("n").scalar()).alias("n"))
    return {"postings": postings, "lengths": lengths, "df": df, "totals": totals}


def query_terms(queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    """(query, term): the distinct terms of each query."""
    return queries.select(query_id, F.explode(F.array_distinct(tokens(text))).alias("term"))


def bm25(index: dict[str, DataFrame], queries: DataFrame, query_id: str, text: Column, chunk_key: Sequence[str], k: int = 8, min_ratio: float = MIN_SCORE_RATIO) -> DataFrame:
    """The ``k`` best chunks of each query: (query, key, score, rank).

    Postings are joined with the query terms and summed per (query, chunk): common terms cost their
    postings once per query that uses them. Few query terms (counted) go to the chunks, whose postings are
    shuffled once; else AQE splits a term that is too long for one task.
    """
    key = list(chunk_key)
    q = query_terms(queries, query_id, text).where(F.col(query_id).isNotNull()).join(index["df"], "term")  # unknown terms do not count
    n = index["totals"].select("n").scalar()
    avgdl = index["totals"].select("avgdl").scalar()
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # the number of its terms goes with each term of a query, so that no sum has to be shuffled to its query for it
    q = stage(q.withColumn("idf", idf).withColumn("nq", F.count(F.lit(1)).over(Window.partitionBy(query_id))), "query-terms")
    few = q.count() <= int_conf(q.sparkSession, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT)
    # dealt by chunk, so that its length and the sums of all queries need no further shuffle; a bounded (counted) table of terms comes to it
    if few:
        postings = index["postings"].dropna(subset=key).repartition(*key).withColumn("dl", F.sum("tf").over(Window.partitionBy(*key)))
    else:
        postings = index["postings"].join(index["lengths"], key)
    hits = postings.join(F.broadcast(q) if few else q, "term")
    norm = K1 * (1 - B + B * (F.greatest("dl", F.lit(1)) / avgdl))
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + norm)
    sums = hits.groupBy(query_id, *key).agg(F.sum(part).alias("raw"), F.sum("in_heading").alias("in_heading"), F.max("nq").alias("nq"))
    score = F.col("raw") * (1 + HEADING_BOOST * F.col("in_heading") / F.col("nq"))
    # nine decimals: copies of one text tie whatever the order their terms were added in
    scored = sums.select(query_id, *key, F.round(score, 9).alias("_score")).where(F.col("_score") > 0)
    top = top_per(scored, [query_id], [F.col("_score").desc(), *[F.col(c) for c in key]], k)
    # k rows of a query are left to be read
    kept = top.withColumn("_best", F.max("_score").over(Window.partitionBy(query_id))).where(F.col("_score") >= F.col("_best") * min_ratio)
    return kept.select(query_id, *key, F.round("_score", 4).alias("score"), "rank")


def floor_and_limit(df: DataFrame, keys: Sequence[str], score: str, ratio: float, n: int, tie: Sequence[str]) -> DataFrame:
    """Top ``n`` rows per key that reach ``ratio`` of the best."""
    top = top_per(df, keys, [F.col(score).desc(), *[F.col(c) for c in tie]], n)
    best = top.where(F.col("rank") == 1).select(*keys, F.col(score).alias("_best"))
    return top.join(best, list(keys)).where(F.col(score) >= F.col("_best") * ratio).drop("_best")


def cite(index: dict[str, DataFrame], rules: DataFrame, chunk_key: Sequence[str], n: int = 3) -> DataFrame:
    """Passages for each rule, its keywords as the query."""
    return bm25(index, rules, "rule_id", F.col("keywords"), chunk_key, n)
