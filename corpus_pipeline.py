"""A corpus pipeline of five stages: quality, language, near-duplicates, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cityjobs.llm import decontam, langid, pieces, quality, simhash
from cityjobs.llm.common import prepare, scratch, table
from cityjobs.llm.queries import PIECE_MODEL


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps; null and empty texts are judged by their statistics, see quality.keep_good."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a language that is told surely; null, empty and letterless texts go, see langid.keep_known."""
    prepare(spark)
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of alike texts, whatever their ids, see simhash.keep_one."""
    prepare(spark)
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage; null and empty texts stay, see decontam.keep_clean."""
    prepare(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row; null texts count as empty, see pieces.encode."""
    prepare(spark)
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality", good),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("token_ids", token_ids),
]

#: The stages fit models, hash and segment texts: SQL has no such functions. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written as Parquet and read again as the next one's documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
