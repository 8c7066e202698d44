"""Queries over documents, pages and conversations: addresses, masking, search, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.net import address_class as classify
from sigspark.functions.net import coarsen_ip as coarsen
from sigspark.functions.net import ips_in, url_host
from sigspark.functions.redact import mask_digits, redact_secrets
from sigspark.functions.sip import digits
from sigspark.operators import search, textindex
from sigspark.plans.registry import query
from sigspark.session import spread, table
from sigspark.sources import files

IP = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
OCTETS = "CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c, CAST(split_part(ip, '.', 4) AS INT) AS d"
PRIVATE = "(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)) AND a <= 255 AND b <= 255 AND c <= 255 AND d <= 255"
IPS = f"""
    WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{IP}', 1))) AS ip FROM documents),
    o AS (SELECT doc_id, ip, {OCTETS} FROM i)
"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def doc_ips(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return d.select("doc_id", F.explode(ips_in(F.col("text"))).alias("ip"))


@query(
    "address_class",
    IPS
    + f"""
    SELECT CASE WHEN (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'documentation'
                WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgnat' WHEN {PRIVATE} THEN 'private' WHEN a <= 255 THEN 'public' ELSE 'unknown' END AS class,
           count(*) AS n_mentions, count(DISTINCT ip) AS n_addresses
    FROM o GROUP BY 1
    """,
)
def address_class(spark, sf):
    return doc_ips(spark, sf).groupBy(classify(F.col("ip")).alias("class")).agg(
        F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("ip").alias("n_addresses")
    )


@query("private_ips", IPS + f"SELECT doc_id, count(*) AS n_ips, count(*) FILTER ({PRIVATE}) AS n_private FROM o GROUP BY 1")
def private_ips(spark, sf):
    d = docs(spark, sf).select("doc_id", F.size(ips_in(F.col("text"))).alias("n"), F.size(ips_in(F.col("text"), private_only=True)).alias("p"))
    return d.where(F.col("n") > 0).select("doc_id", F.col("n").cast("bigint").alias("n_ips"), F.col("p").cast("bigint").alias("n_private"))


@query(
    "coarsen_ip",
    IPS + "SELECT a || '.' || b || '.' || c || '.0' AS network, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM o GROUP BY 1",
)
def coarsen_ip(spark, sf):
    plain = F.array_join(F.transform(F.split("ip", r"\."), lambda x: x.cast("int").cast("string")), ".")
    return doc_ips(spark, sf).groupBy(coarsen(plain).alias("network")).agg(
        F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs")
    )


@query(
    "redact_secrets",
    r"""
    SELECT doc_id, md5(r) AS redacted, length(r) AS n_chars FROM (
      SELECT doc_id, text, regexp_replace(text, '\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\S+', '\1\2REDACTED', 'gi') AS r FROM documents)
    WHERE r <> text
    """,
)
def redact(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", redact_secrets(F.col("text")).alias("r"))
    return d.where(F.col("r") != F.col("text")).select("doc_id", F.md5("r").alias("redacted"), F.length("r").cast("bigint").alias("n_chars"))


@query(
    "mask_numbers",
    r"""
    SELECT doc_id, md5(r) AS masked FROM (SELECT doc_id, text, regexp_replace(text, '(\+?[0-9]{4})[0-9]{2,}([0-9]{2})', '\1…\2', 'g') AS r FROM documents) WHERE r <> text
    """,
)
def mask_numbers(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", mask_digits(F.col("text")).alias("r"))
    return d.where(F.col("r") != F.col("text")).select("doc_id", F.md5("r").alias("masked"))


@query(
    "facet_search",
    """
    SELECT doc_id, 'text' AS field FROM documents
    WHERE lang LIKE 'en%' AND contains(lower(source), 'src1') AND contains(lower(text), 'sh') AND contains(lower(text), 'of the')
    """,
)
def facet_search(spark, sf):
    """lang:en source:src1 sh "of the": two facets, a term and a phrase, all of them."""
    d = docs(spark, sf)
    how = {"lang": search.PREFIX, "source": search.CONTAINS}
    hits = search.search(d, 'lang:en source:src1 sh "of the"', ["text"], "doc_id", cap=None, how=how, facets=list(how))
    return hits.select("doc_id", "field")


@query(
    "digit_search",
    r"""
    SELECT doc_id, CASE WHEN contains(text, '2-123') THEN 'text' ELSE 'number' END AS field FROM documents
    WHERE contains(text, '2-123') OR contains(regexp_replace(text, '[^0-9]', '', 'g'), '2123')
    """,
)
def digit_search(spark, sf):
    """A number however it is written: digits of the query in the digits of the text."""
    d = docs(spark, sf).withColumn("digits", digits(F.col("text")))
    return search.search(d, "2-123", ["text"], "doc_id", cap=None, digits_col="digits").select("doc_id", "field")


@query(
    "search_excerpts",
    r"""
    WITH d AS (SELECT doc_id, text, instr(lower(text), 'token') AS hit FROM documents WHERE contains(lower(text), 'token')),
    e AS (SELECT *, greatest(hit - 40, 1) AS lo FROM d),
    x AS (SELECT *, substring(text, lo, hit - lo + 45) AS shown FROM e)
    SELECT doc_id, 'text' AS field,
           CASE WHEN lo > 1 THEN '...' ELSE '' END || regexp_replace(shown, '\s+', ' ', 'g') || CASE WHEN lo + length(shown) <= length(text) THEN '...' ELSE '' END AS excerpt
    FROM x
    """,
)
def search_excerpts(spark, sf):
    """All hits of a search with the text around each first match."""
    return search.search(docs(spark, sf), "token", ["text"], "doc_id")


@query(
    "scope_rows",
    """
    SELECT conv_id, turn, role FROM conversations
    WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')
    """,
)
def scope_rows(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return search.scope(conv, conv.where("role = 'system'"), ["conv_id"])


@query(
    "html_text",
    """
    SELECT page_id, length(html) AS n_html, len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) > 0 AS has_heading FROM pages
    """,
)
def html_text(spark, sf):
    """Pages as text: a heading in the page is a heading line in its text, and no tag is left."""
    p = spread(table(spark, sf, "pages")).select("page_id", "html", files.html_to_text(F.col("html")).alias("text"))
    return p.select(
        "page_id", F.length("html").cast("bigint").alias("n_html"),
        (F.col("text").rlike(r"(?m)^#{1,6} \S") & ~F.col("text").rlike(r"(?i)</?(p|div|span|script|h[1-6])\b[^>]*>")).alias("has_heading"),
    )


# The rules of html_to_text one by one; the pages hold no entities but these.
SILENT_SQL = ["script", "style", "noscript", "template", "head", "svg", "math"]


def html_sql(html: str) -> str:
    def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"

    x = sub(html, r"(?s)<!--.*?(?:-->|$)", "")
    for name in SILENT_SQL:
        x = sub(x, rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|$)", " ")
    for level in range(1, 7):
        x = sub(x, rf"(?i)<h{level}(?:\s[^>]*)?>\s*", "\n\n" + "#" * level + " ")
    x = sub(x, r"(?i)\s*</h[1-6]\s*>", "\n\n")
    x = sub(x, r"(?i)<li(?:\s[^>]*)?>\s*", "\n- ")
    x = sub(x, r"(?i)<t[dh](?:\s[^>]*)?>", "\t")
    x = sub(x, rf"(?i)</?(?:{files.BLOCKS})(?:\s[^>]*)?/?>", "\n")
    x = sub(x, r"(?s)</?[A-Za-z!?][^>]*>", "")
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    x = sub(x, "[ \\t\u00a0\\r]+", " ")
    x = sub(sub(x, r" ?\n ?", "\n"), r"\n\n+", "\n\n")
    return sub(x, r"^\s+|\s+$", "")


@query(
    "html_body",
    f"""
    SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '<[^>]*>', ' ', 'g'),
                    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title, {html_sql("html")} AS text
    FROM pages
    """,
)
def html_body(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select("page_id", files.html_title(F.col("html")).alias("title"), files.html_to_text(F.col("html")).alias("text"))


@query(
    "url_host",
    r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n_pages FROM pages GROUP BY 1",
)
def url_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))


BARE = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
FEW = f"length({BARE}) <= 100 AND len(string_split({BARE}, ' ')) <= 12"
LETTERS = "length(regexp_replace(line, '[^A-Za-z]', '', 'g'))"
CHUNKS_SQL = rf"""
    WITH p AS MATERIALIZED (SELECT page_id, {html_sql("html")} AS text FROM pages),
    l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
    r0 AS (SELECT *, coalesce(regexp_matches(lead(line) OVER (PARTITION BY page_id ORDER BY pos), '{textindex.RULER}'), false) AND {LETTERS} > 0 AND length({BARE}) <= 100 AS ruled FROM l),
    r AS (SELECT *, regexp_matches(line, '{textindex.RULER}') AND coalesce(lag(ruled) OVER (PARTITION BY page_id ORDER BY pos), false) AS ruler FROM r0),
    h AS (
      SELECT page_id, pos, line, {BARE} = '' AS blank, nullif(trim(CASE
        WHEN regexp_matches(line, '{textindex.HASHES}') THEN regexp_extract(line, '{textindex.HASHES}', 1)
        WHEN regexp_matches(line, '{textindex.BRACKETS}') THEN regexp_extract(line, '{textindex.BRACKETS}', 1)
        WHEN ruled THEN {BARE}
        WHEN regexp_matches(line, '{textindex.NUMBERED}') AND {FEW} AND NOT regexp_matches({BARE}, '[.,;]$') THEN {BARE}
        WHEN {BARE} = upper({BARE}) AND regexp_matches(line, '[A-Z]{{3}}') AND {LETTERS} / greatest(length({BARE}), 1) >= 0.5 AND NOT regexp_matches(line, '[=;|<>{{}}]')
          AND {FEW} AND length({BARE}) >= 3 THEN regexp_replace({BARE}, '[:\s]+$', '') END), '') AS heading
      FROM r WHERE NOT ruler),
    f AS (SELECT *, heading IS NOT NULL AND NOT coalesce(last_value(CASE WHEN NOT blank THEN heading IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS first FROM h),
    n AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS no FROM f),
    s AS (
      SELECT page_id, no, list(heading ORDER BY pos) FILTER (heading IS NOT NULL) AS names,
             regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (heading IS NULL), ''), '^\s+|\s+$', '', 'g') AS body
      FROM n GROUP BY page_id, no),
    b AS (
      SELECT page_id, no, CASE WHEN len(names) > 0 THEN array_to_string(names[greatest(1, len(names) - 1):], ' > ') END AS heading, body FROM s WHERE body <> ''
      UNION ALL SELECT page_id, 0, NULL, text FROM p WHERE text <> '' AND page_id NOT IN (SELECT page_id FROM s WHERE body <> '')),
    sec AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY no) - 1 AS section FROM b),
    q AS (SELECT page_id, section, heading, flatten(list_transform(regexp_extract_all(body, '(?s)[^.!?
]*[.!?]+["'')\]]*\s*|[^.!?
]+
*\s*|\s+'), lambda x: regexp_extract_all(x, '(?s).{{1,300}}(?:\s+|$)|.{{1,300}}'))) AS pieces FROM sec),
    e AS (SELECT page_id, section, heading, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM q),
    c AS (SELECT *, floor(coalesce(sum(length(piece)) OVER (PARTITION BY page_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS cut FROM e),
    m AS (SELECT page_id, section, heading, cut, regexp_replace(string_agg(piece, '' ORDER BY pos), '^\s+|\s+$', '', 'g') AS own FROM c GROUP BY ALL),
    t AS (SELECT *, coalesce(regexp_extract(lag(own) OVER (PARTITION BY page_id, section ORDER BY cut), '(?s)(?:^|\s)(\S.{{0,149}})$', 1), '') AS tail FROM m WHERE own <> '')
    SELECT page_id, CAST(section AS INT) AS section, CAST(row_number() OVER (PARTITION BY page_id ORDER BY section, cut) - 1 AS INT) AS chunk, heading,
           CASE WHEN tail <> '' THEN tail || chr(10) || own ELSE own END AS body
    FROM t
"""


@query("chunks", CHUNKS_SQL)
def chunks(spark, sf):
    """Pages to headed chunks."""
    p = spread(table(spark, sf, "pages")).select("page_id", files.html_to_text(F.col("html")).alias("text"))
    return textindex.sections(p, "page_id")


TOKENS_SQL = (
    "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_À-ɏ]+'), "
    "lambda x: (length(x) > 1 OR regexp_matches(x, '^[0-9]$')) AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in textindex.STOPWORDS)
    + "], x))"
)


@query(
    "postings",
    f"""
    WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents)
    SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term
    """,
)
def postings(spark, sf):
    d = spread(docs(spark, sf).select("doc_id", "text"))
    index = textindex.build_index(d, ["doc_id"], F.col("text"))
    return index["postings"].groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


BM25_SQL = f"""
    WITH t AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents),
    l AS (SELECT doc_id, len(toks) AS dl FROM t),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    q0 AS (SELECT item_id, {TOKENS_SQL} AS toks FROM benchmark),
    q AS (SELECT DISTINCT item_id, unnest(toks) AS term FROM q0),
    h AS (SELECT q.item_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (greatest(dl, 1) / avgdl)))) AS s
          FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc_id), g GROUP BY 1, 2),
    r AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS best, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM h)
    SELECT item_id, doc_id, round(round(s, 9), 4) AS score FROM r WHERE rank <= 8 AND s >= best * 0.08
"""


@query("bm25", BM25_SQL)
def bm25(spark, sf):
    """Every benchmark text as a query over all documents: the eight best each."""
    d = spread(docs(spark, sf).select("doc_id", "text"))
    index = textindex.build_index(d, ["doc_id"], F.col("text"))
    hits = textindex.bm25(index, table(spark, sf, "benchmark"), "item_id", F.col("text"), ["doc_id"])
    return hits.select("item_id", "doc_id", "score")


@query(
    "file_kinds",
    """
    SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\t\n\r -~]', '', 'g')) >= 0.85 * greatest(length(text), 1) THEN 'printable' ELSE 'other' END AS kind FROM documents
    """,
)
def file_kinds(spark, sf):
    """Printable share of whole texts, the test that tells text logs from other files."""
    bare = F.regexp_replace("text", r"[^\t\n\r -~]", "")
    share = F.length(bare) >= F.lit(0.85) * F.greatest(F.length("text"), F.lit(1))
    return docs(spark, sf).select("doc_id", F.when(share, "printable").otherwise("other").alias("kind"))
