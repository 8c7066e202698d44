"""Language identification by compression.

From a bounded sample of labelled texts one zstandard raw-content dictionary per language is made. A text is
normalised (lower case, letters and single spaces) and cut into segments; each segment is compressed with each language's
dictionary, and the language with the smallest sum of sizes wins. Segments keep the text from becoming its own
dictionary, so long texts are judged like short ones. The margin is the bits per letter saved against the second
best; the score is 1 / (1 + 2^(-SHARPNESS * margin)), one half for a tie; a text is rejected when the margin is narrow.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; equal sizes go to the smaller
language name; no labelled text at all: every text is ``und``; one language alone: score 1; repeated rows each get a row; an
empty table gives an empty result; other columns stay, clashing ones (``lang_pred``, ``score``, ``rejected``) as ``<name>_in``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from sigspark.llm.common import WORKER_HELD, set_aside, text_batches
from sigspark.plans.slices import top_per

UND = "und"
OWN = ["lang_pred", "score", "rejected"]
# Bounds of the sample that the dictionaries are made of: texts per language, characters of a text, bytes per language, languages.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES, MAX_LANGUAGES = 300, 4_000, 112_000, 64
SEGMENT = 1_600
LEVEL = 5
SHARPNESS = 40.0
# Bits per letter by which the best must beat the second best.
MIN_MARGIN = 0.005
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def normalise(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """A dictionary per language, from at most ``sample_texts`` texts of each, chosen by a hash of ``order``.

    At most MAX_LANGUAGES languages with most texts are learned. What reaches the driver is bounded by these parameters.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(7), F.col(order)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = [r[0] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()]
    # choose by the hash alone, so that texts don't pass through the ranking
    keys = top_per(rows.select("lang", "h").where(F.col("lang").isin(known)), ["lang"], [F.col("h")], sample_texts)
    bound = keys.groupBy("lang").agg(F.max("h").alias("upto"))
    chosen = rows.join(F.broadcast(bound), "lang").where("h <= upto")
    # the same hash may stand for many rows when ids repeat: take the first few texts of each language all the same
    chosen = top_per(chosen.select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")), ["lang"], [F.col("h"), F.col("text")], sample_texts)
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(normalise(r["text"]))
    return {k: " ".join(v).encode()[-dictionary_bytes:] for k, v in sorted(out.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = list(dictionaries)
        self.tools = []
        for content in dictionaries.values():
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.tools.append(z.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin in bits per letter."""
        plain = normalise(text or "")
        # marks alone are no letters
        if not LETTER.search(plain) or not self.names:
            return UND, 0.0, 0.0
        sizes = np.zeros(len(self.names))
        for i in range(0, len(plain), SEGMENT):
            segment = plain[i : i + SEGMENT].encode()
            sizes += [len(t.compress(segment)) for t in self.tools]
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[best], 1.0, float("inf")
        margin = 8.0 * (np.partition(sizes, 1)[1] - sizes[best]) / len(plain)
        return self.names[best], float(1.0 / (1.0 + 2.0 ** (-margin * SHARPNESS))), float(margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected (no letters, or a margin below ``min_margin``)."""
    kept = set_aside(docs, OWN)
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages * dictionary_bytes
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WORKER_HELD.clear()
        tool = Classifier(sent.value)
        for batch in batches:
            got = [tool.judge(t.as_py()) for t in batch.column(at)]
            names = pa.array([g[0] for g in got], pa.string())
            scores = pa.array([g[1] for g in got], pa.float64())
            rejected = pa.array([g[0] == UND or g[2] < min_margin for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, scores, rejected], [*batch.schema.names, *OWN])

    return kept.mapInArrow(run, schema)


def labelled(docs: DataFrame, held_out: Column, lang: str = "lang") -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & ~held_out)
