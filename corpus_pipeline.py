"""From raw documents to tokens: five stages, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.llm import bpe, decontam, linededup, quality, simhash
from lexigrove.llm.common import Shared, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, finds good and not toxic."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later repeated runs of lines; n_chars is that of the new text."""
    out = linededup.dedup_lines(docs)
    n_chars = F.when(F.col("deleted_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, and all that are in no group."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no long run of words with a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every document."""
    return bpe.encode(docs, verify=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokenise)]

#: SQL expresses neither the classifier nor SimHash nor BPE: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, docs, old = Shared(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = shared.write(stage(spark, docs, sf_dir))
        if old:
            shared.drop(old)
        old = path
    return docs
