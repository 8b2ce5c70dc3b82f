"""The operators over whole tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.llm import (
    checks, clustering, decontam, html, lines, lm, mixing, phrases, pieces, quality, secrets, simhash, toxicity, urls,
)
from listwright.llm.base import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: Listed hosts and paths with their verdicts.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Hosts that are listed whole.
URL_BLOCKED = [
    "ads-track.example.com/", "spam-farm.example.org/", "casino-win.example.net/", "adult-x.example.com/",
    "cheap-pills.example.net/", "free-bets.example.net/",
]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    field = html.train(pages)
    rows = pages.select("page_id", "url", html.main_text(F.col("html"), field).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.graded(F.col("text"), model).alias("found")).select("doc_id", "found.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "key string, verdict string")
    blocked = spark.createDataFrame([(key,) for key in URL_BLOCKED], "key string")
    return urls.judged(table(spark, sf_dir, "pages"), rules, blocked)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(lm.count(table(spark, sf_dir, "documents"), keep_tables=False))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.digests(F.col("text"), PIECES).alias("found")).select("doc_id", "found.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings")).report()


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_simhash_near_dedup, op3_benchmark_decontamination, op4_quality_rules, op5_html_extraction,
        op6_toxicity, op7_url_filter, op8_lm_scores, op9_sentencepiece, op10_line_dedup, op11_centroid_clustering,
        op12_phrase_mining, op13_source_mixing,
    )
}
CHECKS: dict[str, str] = dict(checks.CHECKS)
