"""Columns named like those that the operators add, and very long texts, change no result."""

import random

import pytest
from pyspark.sql import functions as F

from listwright.llm import decontam, html, quality, secrets
from listwright.llm.base import shared_path

NAMES = ["words", "word", "value", "place", "piece", "letters", "trigram", "known", "share", "label", "features", "probability",
         "h", "n", "n_words", "n_hit", "items", "item_id", "window", "line", "lines", "kept", "mark", "_mark", "pos", "col", "_id", "source"]


def clashing(frame):
    taken = {c.lower() for c in frame.columns}
    for name in NAMES:
        if name not in taken:
            frame = frame.withColumn(name, F.lit(7))
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + ". The end of it is here, as it is.\n" * (1 + i % 4)) for i in range(60)]
    rows += [(100 + i, f"api_key = \"{''.join(rng.choices('abcdefXYZ0123456789', k=32))}\" and more words") for i in range(30)]
    rows += [(200, None), (201, ""), (202, "long words of text " * 15_000), (203, "x1" * 10_000), (None, "no id at all"), (1, rows[1][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_quality(docs):
    expected = rows(quality.statistics(docs))
    assert len(expected) == docs.count()
    assert rows(quality.statistics(clashing(docs))) == expected


def test_secrets(docs):
    assert rows(secrets.scanned(clashing(docs))) == rows(secrets.scanned(docs)) != []
    assert secrets.scanned(docs.limit(0)).collect() == []


def test_decontamination(spark, docs):
    text = docs.filter("doc_id = 5").first()["text"]
    benchmark = spark.createDataFrame([(1, text[:200]), (2, None), (3, ""), (4, "long words of text " * 5)], "item_id long, text string")
    expected = rows(decontam.judged(docs, benchmark))
    assert len(expected) == docs.count()
    odd = benchmark.withColumn("doc_id", F.lit(1)).withColumn("words", F.lit(2)).withColumn("h", F.lit(3))
    assert rows(decontam.judged(clashing(docs), odd)) == expected


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(i, f"u{i}", f"<body><nav>Menu</nav><article><h1>T{i}</h1>" + f"<p>A sentence of page {i} that ends.</p>" * (3 if i else 8_000) + "</article>")
         for i in range(12)] + [(None, None, None)], "page_id long, url string, html string")
    expected = {r["page_id"]: r["text"] for r in pages.select("page_id", html.main_text(F.col("html"), html.train(pages)).alias("text")).collect()}
    odd = clashing(pages).withColumn("number", F.lit(1)).withColumn("text", F.lit("own"))
    found = {r["page_id"]: r["t"] for r in odd.select("page_id", html.main_text(F.col("html"), html.train(odd)).alias("t")).collect()}
    assert found == expected and expected[None] == "" and len(expected[0]) > 250_000


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Conf:
        def __init__(self, **own):
            self.own = own

        def get(self, key, default=None):
            return self.own.get(key.replace(".", "_"), default)

    class Session:
        pass

    session = Session()
    session.conf = Conf(spark_master="spark://host:7077", spark_sql_warehouse_dir="/w")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session, "x")
    session.conf = Conf(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_path(session, "x").startswith("hdfs:///shared/x-")
    session.conf = Conf(spark_master="local[4]", spark_sql_warehouse_dir="/w")
    assert shared_path(session, "x").startswith("/w-scratch/x-")
