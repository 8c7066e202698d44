"""A training corpus from the documents: language ID, near-duplicates, benchmark leaks, mixture, token records.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Its result is written and read again
before the next. All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import decontaminate, langid, mixing, paritysketch, tokenfile
from sigspark.llm.common import held_out, named_back, new_folder
from sigspark.session import stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter or whose language is a close call."""
    dictionaries = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    judged = langid.identify(docs, dictionaries)
    return named_back(judged.where("NOT rejected"), docs, langid.OWN)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return paritysketch.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), drop="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources up to half as often again."""
    return named_back(mixing.mix(docs, repetition=1.5), docs, mixing.OWN)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records, read back from their files."""
    folder = new_folder(spark, "corpus")
    tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return tokenfile.read(spark, folder)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
    ("token records", write_tokens),
]

# Compression sizes, seeded permutations and the tokenizer are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
