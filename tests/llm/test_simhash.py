import itertools
import random

import numpy as np
import pytest
import xxhash

from listwright.llm import simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=4):
    """Smallest position reachable for each, by comparing all."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def near(rng, value, flips):
    for bit in rng.sample(range(64), flips):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "one", "one Two three", "one two three four", "A b C d e f É É é g", "x " * 70_000,
])
def test_fingerprint_is_that_of_counting_bits(text):
    assert simhash.text_fingerprint(text) & (2**64 - 1) == slow_fingerprint((text or "").replace("\t", " "))


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_connects_what_comparing_all_connects(seed):
    rng = random.Random(seed)
    groups = []
    for _ in range(12):
        middle = rng.getrandbits(64)
        groups.append(sorted({near(rng, middle, rng.randrange(8)) for _ in range(rng.randrange(1, 60))}))
    leaves = np.array([x for g in groups for x in g], np.uint64)
    trie = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    root = simhash.trie_join(trie, leaves, 4)
    start = 0
    for group in groups:
        assert [r - start for r in root[start:start + len(group)].tolist()] == slow_components(group)
        start += len(group)


def prints_frame(spark, prints):
    return spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")


@pytest.mark.parametrize("cell", [1024, 8])
def test_links_lose_no_component(spark, cell):
    rng = random.Random(7)
    prints = set()
    for _ in range(15):
        value = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):  # chains, so that members can be far apart
            prints.add(value)
            value = near(rng, value, rng.randrange(1, 7))
    prints = sorted(prints)
    edges = simhash.links(prints_frame(spark, prints), cell=cell)
    roots = {r["a"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(edges).collect()}
    expected = slow_components(prints)
    assert len({roots.get(p, p) for p in prints}) == len(set(expected))
    for p, e in zip(prints, expected):
        assert roots.get(p, p) == roots.get(prints[e], prints[e])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["a"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 61)}


def test_classes_of_copies_nulls_and_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base.upper()), (9, base), (9, base), (1, None), (2, ""), (None, base), (4, "other words entirely here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.classes(docs).collect())
    assert found == sorted([("5", 3), ("3", 3), ("9", 3), ("9", 3), ("1", 1), ("2", 1), ("None", 3), ("4", 4)])


def test_one_of_each_group_stays_with_all_columns(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base, 1), (5, base, 2), (3, base, 3), (1, None, 4), (2, " ", 5), (8, "a b c d e", 6), (8, "a b c d e", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "mark"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 8]


def test_one_of_a_group_without_ids_stays(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "f g h i j")], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(docs).collect()) == ["7", "None"]


def test_each_group_keeps_its_own_document_where_ids_are_shared_or_missing(spark):
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcdef"]
    a, b, c, d, e, f = texts
    rows = [(None, a, 1), (None, b, 2), (None, b, 2), (8, c, 3), (8, d, 4), (8, d, 4), (9, d, 5), (9, e, 6), (None, e, 7), (9, f, 8), (7, f, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = sorted((r["text"], str(r["doc_id"])) for r in simhash.one_of_each(docs).collect())
    assert kept == [(a, "None"), (b, "None"), (c, "8"), (d, "8"), (e, "9"), (f, "7")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.classes(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0
