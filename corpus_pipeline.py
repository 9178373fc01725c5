"""A corpus from raw documents to packed sequences, stage by stage; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions.shipping import ship_package
from sitemill.llm import language_id, near_dedup, packing, secret_scan, suffix_dedup
from sitemill.llm.common import read, shared_table, tokenizer_path

#: Repeated passages of so many bytes lose their later copies: less than 50 words have.
REPEAT_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; those without letters, or of no clear language, go."""
    ship_package(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of REPEAT_BYTES; no document goes, and n_chars follows the text."""
    ship_package(spark)
    return suffix_dedup.remove_later_copies(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret; no document goes, and n_chars follows the text."""
    ship_package(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]

#: SQL expresses neither the network nor the packing. Tests hold each stage's operator against brute force, and the stages one after
#: another against what made-up documents must come to.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents, each stage written and read again by the next.

    A null or empty text, or one without letters, goes with the first stage; a null doc_id or source stays as it is; columns beyond those
    of documents are carried to the last stage. An empty table, or one of which no document stays, gives no rows with the same columns.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
