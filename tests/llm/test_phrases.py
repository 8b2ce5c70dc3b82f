import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import phrases

SCHEMA = "doc_id bigint, lang string, text string"


def brute(rows, least=30, top=2000):
    grams, totals = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    grams[lang, tuple(words[i:i + n])] += 1
    found = []
    for (lang, words), a in grams.items():
        if len(words) < 2 or a < least:
            continue
        cut = min((2000000 * a // (grams[lang, words[:k]] + grams[lang, words[k:]]), k) for k in range(1, len(words)))
        longer = [f for (other, w), f in grams.items() if other == lang and len(w) > len(words) and f >= least
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * f >= 80 * a for f in longer):
            continue
        l, r = grams[lang, words[:cut[1]]], grams[lang, words[cut[1]:]]
        found.append((lang, " ".join(words), a, l, r, totals[lang], cut[0]))
    ranked = []
    for lang in {f[0] for f in found}:
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        ranked += [(lang, n + 1, *f[1:]) for n, f in enumerate(own[:top])]
    return sorted(ranked)


def corpus(rng, n=300):
    vocabulary = [f"w{i}" for i in range(40)] + ["Der", "THE", "Été", "x\x1cy", "a b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["new york city hall", "Ad hoc", "q r s t u"]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(fixed))
        rows.append((i, rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for w in words)))
    return rows


@pytest.mark.parametrize("seed,block_words,part_entries", [(0, 1 << 19, 1 << 21), (1, 200, 64), (2, 50, 1)])
def test_phrases_are_those_of_plain_counting(spark, seed, block_words, part_entries):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = phrases.mined(docs, least=10, top=40, block_words=block_words, part_entries=part_entries)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, 10, 40)
    assert len(expected) > 20
    assert sorted(map(tuple, found.select(*columns).collect())) == expected


def test_several_rounds_of_merging_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROUND_BITS", 2)
    rows = corpus(random.Random(7), 120)
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = phrases.blocks(docs, 100)
    words = phrases.word_counts(packed)
    vocabulary = phrases.numbered(words.filter("f >= 5"))
    bits = max((vocabulary.count() - 1).bit_length(), 1)
    encoded = packed.join(phrases.block_ids(packed, vocabulary), "block")
    counts = [
        sorted((tuple(r["ids"]), r["f"]) for r in phrases.frequent(
            phrases.block_filters(encoded, bits, part_bits), bits, part_bits, 5).collect())
        for part_bits in (0, 2, 5, 6)
    ]
    assert counts[0] and all(c == counts[0] for c in counts)


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 9), (3, 7), (4, 16), (3, 31), (4, 17), (4, 32)])
def test_packing_and_permutation_are_undone(n, bits):
    rng = np.random.default_rng(n * bits)
    ids = [rng.integers(0, 1 << bits, 500) for _ in range(n)]
    packing = phrases.Packing(n, bits)
    packed = packing.pack(ids)
    permuted = packing.permute(*packed)
    assert all((a == b).all() for a, b in zip(packing.restore(*permuted), packed))
    assert all((a == b).all() for a, b in zip(packing.unpack(*packed), ids))
    assert len(set(zip(*(x.tolist() for x in permuted)))) == len(set(zip(*(x.tolist() for x in packed))))


@pytest.mark.parametrize("n,bits,part_bits", [(2, 3, 0), (2, 9, 2), (4, 16, 5), (3, 31, 0), (4, 32, 3), (2, 1, 1)])
def test_filters_give_back_their_entries(n, bits, part_bits):
    rng = np.random.default_rng(bits)
    packing = phrases.Packing(n, bits)
    high, low = packing.permute(*packing.pack([rng.integers(0, 1 << bits, 3000) for _ in range(n)]))
    high, low, counts = phrases.merged(high, low, rng.choice([1, 2, 254, 255, 256, 1 << 40], 3000), packing.half)
    parts = packing.leading(high, part_bits)
    for part in np.unique(parts):
        own = parts == part
        blob = phrases.encode(high[own], low[own], counts[own], packing.half, part_bits)
        back = phrases.decode(blob, packing.half, int(part), part_bits)
        assert all((a == b).all() for a, b in zip(back, (high[own], low[own], counts[own])))


def test_filters_are_smaller_than_their_numbers():
    packing = phrases.Packing(4, 14)
    rng = np.random.default_rng(0)
    high, low, counts = phrases.tallied(*packing.permute(*packing.pack([rng.integers(0, 1 << 14, 100000) for _ in range(4)])), packing.half)
    assert len(phrases.encode(high, low, counts, packing.half, 0)) < 8 * len(high)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "en", ""), (2, "en", " \t. ,"), (3, None, "Ab cd " * 40), (3, "und", "aB cD"),
            (4, "en", "x y " * 50000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit(1)).withColumn("id", F.lit(2)).withColumn("block", F.lit(3))
    found = {(r["lang"], r["phrase"]): r for r in phrases.mined(docs).collect()}
    assert sorted(map(tuple, (tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.values()))) == brute(rows)
    assert found["und", "ab cd ab cd"]["n"] == 82
    assert found["en", "x y x y"]["a"] == 49999
    assert phrases.mined(docs.limit(0)).collect() == []
    assert phrases.mined(docs.filter("doc_id = 1")).collect() == []


def test_products_may_pass_64_bits(spark):
    grams = spark.createDataFrame(
        [([1], 9 * 10**18), ([2], 9 * 10**18), ([1, 2], 8 * 10**18 + 7)], "ids array<bigint>, f bigint"
    )
    row = phrases._scored(grams).first()
    assert row["score"] == 2000000 * (8 * 10**18 + 7) // (18 * 10**18)
