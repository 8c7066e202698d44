"""Typed scans, file classification, access logs, documents."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.sources.textlog import is_start

# Leading bytes of capture files.
MAGIC = {
    "A1B2C3D4": "pcap", "D4C3B2A1": "pcap", "A1B23C4D": "pcap", "4D3CB2A1": "pcap", "0A0D0D0A": "pcapng",
}
ACCESS = r'^(\S+) (\S+) ([A-Z]+) (\S+) (\d{3}) (\d+)ms(?: "(.*)")?$'


def read_table(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(rows, warnings): a typed scan that records unreadable rows instead of failing."""
    if form == "parquet":
        return spark.read.schema(schema).parquet(path), spark.createDataFrame([], "source string, warning string")
    # line by line rather than by the file reader, so that bad rows can be selected on their own
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parse = F.from_json if form == "json" else F.from_csv
    shape = full if form == "json" else full.simpleString()[7:-1].replace(":", " ")
    raw = lines.where(F.trim("value") != "").select("source", parse("value", shape, options).alias("r"))
    bad = raw.where(F.col("r._corrupt").isNotNull()).select("source", F.concat(F.lit("unreadable row: "), F.substring("r._corrupt", 1, 200)).alias("warning"))
    return raw.where(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt"), bad


def classify_content(content: Column, printable_share: float = 0.85) -> Column:
    """pcap, pcapng, text-log or unknown, by content alone."""
    magic = F.hex(F.substring(content, 1, 4))
    whole = F.decode(content, "ISO-8859-1")
    bare = F.regexp_replace(whole, r"[^\t\n\r -~]", "")
    printable = F.length(bare) / F.greatest(F.length(whole), F.lit(1)) >= printable_share
    looks = F.exists(F.split(bare, "\n"), is_start) | bare.rlike(r"(?i)\b(?:received\s+from|sent\s+to)\b") | bare.rlike(r"(?m)^\s*[UTR]\s+\d{4}[/-]\d")
    kind = F.lit("unknown")
    for value, name in MAGIC.items():
        kind = F.when(magic == value, name).otherwise(kind)
    return F.when(kind != "unknown", kind).when(printable & looks, "text-log").otherwise("unknown")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of landed files; the name of a file says nothing."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", classify_content(F.col("content")).alias("format"))


def parse_access_log(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, legacy): typed access-log rows, and the number of lines of the form without a time."""
    line = F.trim(F.col(value))
    g = [F.regexp_extract(line, ACCESS, i) for i in range(1, 8)]
    ts = g[0].try_cast("timestamp")
    rows = lines.where(line.rlike(ACCESS)).select(
        ts.alias("ts"), g[1].alias("ip"), g[2].alias("method"), g[3].alias("path"), g[4].cast("int").alias("status"), g[5].cast("bigint").alias("ms"), g[6].alias("ua")
    )
    legacy = lines.where(~line.rlike(ACCESS) & line.rlike(r"^[A-Z]+ /")).agg(F.count(F.lit(1)).alias("legacy_lines"))
    return rows.where(F.col("ts").isNotNull()), legacy


def read_access_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_access_log(spark.read.text(path))


# Named characters of text: the whole of Latin-1, and the punctuation, spaces and signs that pages use beside it.
BEYOND_LATIN1 = "ndash mdash lsquo rsquo sbquo ldquo rdquo bdquo hellip bull trade euro ensp emsp thinsp larr rarr uarr darr minus le ge ne".split()
ENTITIES = {n: chr(c) for n, c in name2codepoint.items() if c < 256 or n in BEYOND_LATIN1} | {"apos": "'", "nbsp": " "}
# Elements whose content is not text, and elements that begin and end a line of their own.
SILENT = ["script", "style", "noscript", "template", "head", "svg", "math"]
BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|header|hr|html|"
    "legend|li|main|menu|nav|ol|optgroup|option|p|pre|section|summary|table|tbody|tfoot|thead|title|tr|ul"
)
LAST_CODE_POINT = 0x10FFFF


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded in one pass, so that nothing is decoded twice; unknown ones stay."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});", 1)
        hexadecimal = F.conv(F.substring(name, 3, 6), 16, 10).try_cast("long")
        code = F.when(name.rlike("^#[xX]"), hexadecimal).when(name.startswith("#"), F.substring(name, 2, 7).try_cast("long"))
        sound = code.between(1, LAST_CODE_POINT) & ~code.between(0xD800, 0xDFFF)
        char = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNull(), F.try_element_at(known, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    out = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Readable text of a page: one line per block, ``#`` marks before headings, ``-`` before list items, cells apart.

    Comments and what is not text go first, then every tag becomes the break that its element makes in a line.
    """
    s = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    for name in SILENT:
        s = F.regexp_replace(s, rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|$)", " ")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?i)<h{level}(?:\s[^>]*)?>\s*", "\n\n" + "#" * level + " ")
    s = F.regexp_replace(s, r"(?i)\s*</h[1-6]\s*>", "\n\n")
    s = F.regexp_replace(s, r"(?i)<li(?:\s[^>]*)?>\s*", "\n- ")
    s = F.regexp_replace(s, r"(?i)<t[dh](?:\s[^>]*)?>", "\t")
    s = F.regexp_replace(s, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    s = decode_entities(F.regexp_replace(s, r"(?s)</?[A-Za-z!?][^>]*>", ""))
    # blanks around line ends go, and no more than one empty line stays
    s = F.regexp_replace(s, "[ \\t\u00a0\\r]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n\n+", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    plain = decode_entities(F.regexp_replace(t, r"<[^>]*>", " "))
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def docs_to_text(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Documents of one kind (html, markdown, ini, plain) to plain text."""
    return df.withColumn(text, html_to_text(F.col(text))) if kind == "html" else df
