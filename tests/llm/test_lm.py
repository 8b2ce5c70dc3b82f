import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import lm

SCHEMA = "doc_id long, text string"
CORPUS = [(1, "a b a b c"), (2, "a b"), (3, None), (4, " \n"), (5, "c c c"), (1, "a b a b c"), (None, "b a"), (6, "b a b a\tb a c")]
START = object()


def slow(docs, corpus, order=3, least=2):
    grams = Counter()
    for _, text in corpus:
        own = (text or "").split()
        if own:
            own = [START, *own]
            grams.update(tuple(own[i:i + n]) for n in range(1, order + 1) for i in range(len(own) - n + 1))
    total = sum(c for g, c in grams.items() if len(g) == 1 and g[0] is not START)
    found = []
    for doc_id, text in docs:
        own = [START, *(text or "").split()]
        logs = []
        for i in range(1, len(own)):
            steps = 0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(own[i - n + 1:i + 1])
                if n == 1:
                    logs.append(steps * math.log(0.4) + math.log(max(grams[gram], 1) / max(total, 1)))
                elif grams[gram] >= least:
                    logs.append(steps * math.log(0.4) + math.log(grams[gram] / grams[gram[:-1]]))
                    break
                steps += 1
        found.append((doc_id, len(logs), round(sum(logs) / len(logs), 6) if logs else None))
    return sorted(found, key=str)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def close(found, expected):
    assert [(r[0], r[1]) for r in found] == [(r[0], r[1]) for r in expected]
    assert [r[2] for r in found] == [None if r[2] is None else pytest.approx(r[2], abs=2e-6) for r in expected]


@pytest.mark.parametrize("order,least,block_words,part_words", [(3, 2, 1 << 19, 1 << 22), (3, 2, 4, 3), (2, 1, 1, 1), (1, 2, 9, 2), (4, 3, 6, 5)])
def test_scores_of_the_corpus(spark, order, least, block_words, part_words):
    docs = spark.createDataFrame(CORPUS, SCHEMA).repartition(3)
    counts = lm.count(docs, order, least, block_words, part_words)
    expected = slow(CORPUS, CORPUS, order, least)
    close(rows(lm.score_corpus(counts)), expected)
    close(rows(lm.score(docs, counts, block_words)), expected)


def test_larger_texts_back_off_at_every_depth(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    corpus = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 60)))) for i in range(80)]
    other = [(100 + i, " ".join(rng.choices([*words, "new"], k=20))) for i in range(20)]
    counts = lm.count(spark.createDataFrame(corpus, SCHEMA), block_words=300, part_words=200)
    close(rows(lm.score_corpus(counts)), slow(corpus, corpus))
    close(rows(lm.score(spark.createDataFrame(other, SCHEMA), counts)), slow(other, corpus))


def test_tables_hold_what_is_frequent(spark):
    counts = lm.count(spark.createDataFrame(CORPUS, SCHEMA), part_words=2)
    sizes = [sum(len(lm._hashes(r["hashes"])) for r in table.collect() if r["hashes"]) for table in counts.tables]
    grams = Counter()
    for _, text in CORPUS:
        own = [START, *(text or "").split()]
        if len(own) > 1:
            grams.update(tuple(own[i:i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1))
    assert sizes == [sum(len(g) == n and (c >= 2 or n == 1) for g, c in grams.items()) for n in (1, 2, 3)]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for hashes in (rng.integers(0, 1 << 63, 50), rng.integers(0, 1 << 20, 500), [5], [0, 1 << 63, (1 << 64) - 1]):
        hashes = np.unique(np.array(hashes, np.uint64))
        assert (lm._hashes(lm._steps(hashes)) == hashes).all()
    chunks = [rng.choice([0, 1, 254, 255, 256, 1 << 40], n) for n in (0, 1, 100)]
    assert (lm._counts(b"".join(map(lm._bytes, chunks))) == np.concatenate(chunks)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x " * 60000), (2, None), (3, ""), (4, "x"), (4, "x")], SCHEMA)
    docs = docs.withColumn("text_", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("counts", F.lit(2)).withColumn("block", F.lit(3))
    found = rows(lm.score_corpus(lm.count(docs)))
    close(found, slow([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in docs.collect()]))
    blank = docs.filter("doc_id in (2, 3)")
    assert rows(lm.score_corpus(lm.count(blank))) == [(2, 0, None), (3, 0, None)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    counts = lm.count(none)
    assert lm.score_corpus(counts).count() == 0
    found = lm.score(spark.createDataFrame([(1, "a b")], SCHEMA), counts).collect()
    assert [tuple(r) for r in found] == [(1, 2, round((3 * math.log(0.4)) / 2, 6))]
