"""A corpus pipeline: toxic documents go, then repeated lines, near copies and contaminated documents;
what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.llm import decontam, lines, pieces, simhash, toxicity
from listwright.llm.base import fresh, shared_path, shuffles_dropped, table

#: Decoding and encoding depend on a vocabulary, SimHash on XXH64: SQL has neither.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled ones, doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found, = fresh(docs, "found")
    graded = docs.withColumn(found, toxicity.graded(F.col("text"), model))
    return graded.filter(~F.col(found)["toxic"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines of later occurrences."""
    return lines.deduplicated(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return docs.select("doc_id", pieces.digests(F.col("text"), model).alias("found")).select("doc_id", "found.*")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near copies", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
