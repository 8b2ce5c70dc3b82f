import random

import pytest
from pyspark.sql import functions as F

from listwright.llm import mixing

SCHEMA = "doc_id bigint, source string, text string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, the excess dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in full and share[s] > most * sizes[s]}
        if not above:
            return share
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_dealing_the_excess_again(spark, seed):
    rng = random.Random(seed)
    sizes = {s: int(10 ** rng.uniform(0, 5)) for s in ["a", "b", "B", "é", "\U0001f600", "zz", "", None][: rng.randint(2, 8)]}
    cells = spark.createDataFrame(list(sizes.items()), "source string, words bigint")
    found = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(cells).collect()}
    assert {s: v[0] for s, v in found.items()} == sizes
    assert {s: v[1] for s, v in found.items()} == pytest.approx(brute_targets(sizes))


def corpus(rng, n=600, sources=("a", "b", "c", None), longest=60):
    # A third of all documents is of one source.
    return [(i, "a" if i % 3 == 0 else rng.choice(sources), " ".join(["w"] * rng.randint(0, longest)) + f"\n{i % 50}")
            for i in range(n)]


def brute_taken(spark, docs, boundary):
    """Whole rows walked in rank order, source by source, by the rule of the docstring."""
    rows = mixing.sized(docs)
    cells = rows.groupBy("source", "w").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    scaled = mixing.scales(cells, mixing.targets(cells)).cache()
    gaps = {r["source"]: r["gap"] for r in scaled.collect()}
    ranked = mixing.ranked(rows, scaled).collect()
    taken = {}
    for source, gap in gaps.items():
        own = sorted((r for r in ranked if r["source"] == source and r["rank"] is not None),
                     key=lambda r: (r["rank"], r["doc_id"]))
        more, missed = {}, []
        for r in own:
            fits = max(0, min(r["m"], int(gap // r["size"])))
            more[r["doc_id"], r["mark"]] = fits
            gap -= fits * r["size"]
            if fits < r["m"]:
                missed.append((r["size"], len(missed), r))
        late = [x for x in missed if x[0] < 2 * gap]
        if late:
            r = min(late)[2]
            more[r["doc_id"], r["mark"]] += 1
        for r in ranked:
            if r["source"] == source:
                sure = r["sure"] * r["m"] if r["size"] else 0
                taken[r["doc_id"], r["mark"]] = sure + more.get((r["doc_id"], r["mark"]), 0)
    return taken


def test_copies_are_those_of_a_walk_in_rank_order(spark):
    docs = spark.createDataFrame(corpus(random.Random(1)), SCHEMA)
    found = mixing.allocated(docs, boundary=1024).collect()
    assert {(r["doc_id"], r["mark"]): r["copies"] for r in found} == brute_taken(spark, docs, 1024)


def test_a_small_boundary_cuts_at_the_same_place(spark):
    rows = corpus(random.Random(2), 3000)
    docs = spark.createDataFrame(rows, SCHEMA)
    for boundary in (16, 200):
        found = mixing.taken(docs, boundary=boundary).groupBy("source_size", "target").agg(
            F.sum("taken").alias("taken"), F.max("size").alias("largest")
        ).collect()
        assert found and all(abs(r["taken"] - r["target"]) <= r["largest"] for r in found)
    # Ranks before the cut are taken whichever boundary is walked.
    assert mixing.taken(docs, boundary=16).count() == 3000


def test_no_document_is_taken_more_than_three_times_and_reruns_agree(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.taken(docs).collect()
    assert len(found) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in found)
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    other = mixing.taken(docs, seed=8).collect()
    assert sorted(map(tuple, found)) != sorted(map(tuple, other))


def test_chances_are_those_wanted(spark):
    """Over many seeds a document is taken about as often as c x w says."""
    rows = [(i, "s" if i % 2 else "t", " ".join(["w"] * (1 + i % 7))) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = mixing.sized(docs)
    cells = sizes.groupBy("source", "w").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    scaled = {r["source"]: r["c"] for r in mixing.scales(cells, mixing.targets(cells)).collect()}
    wanted = {i: min(3.0, scaled[s] * (1 + i % 7).bit_length()) for i, s, _ in rows}
    seen = dict.fromkeys(wanted, 0)
    runs = 5
    for seed in range(runs):
        for r in mixing.taken(docs, seed=seed).select("doc_id", (F.col("taken") / F.col("size")).alias("n")).collect():
            seen[r["doc_id"]] += r["n"]
    for group in range(7):
        ids = [i for i in wanted if i % 7 == group]
        mean = sum(seen[i] for i in ids) / runs / len(ids)
        assert mean == pytest.approx(sum(wanted[i] for i in ids) / len(ids), abs=0.25)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", ""), (1, "a", "x y"), (1, "a", "x y"), (1, "a", "z"), (2, "a", " \t\n"),
            (3, "b", "w " * 40000), (4, "a", "x y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("mark", F.lit(1))
    docs = docs.withColumn("target", F.lit(0)).withColumn("rank", F.lit(0))
    found = mixing.taken(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == [0, 0, 0, 1, 2, 2, 2, 40000]
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
    assert sum(r["taken"] for r in found if r["source_size"] == 7) == 21
    assert mixing.taken(docs.limit(0)).collect() == []
    assert mixing.taken(docs.filter("text is null")).select("taken", "target").collect() == [(0, 0.0)]


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(corpus(random.Random(4), 200), SCHEMA).withColumn("mark", F.lit("own"))
    found = mixing.mixed(docs)
    assert found.columns == docs.columns
    wanted = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.allocated(docs).filter("copies > 0").collect()}
    assert {(r["doc_id"], r["source"]): r["n"] for r in found.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()} == wanted


def test_a_weight_of_the_callers(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w w w") for i in range(300)], SCHEMA)
    heavy = F.when(F.col("doc_id") < 20, 50).otherwise(None)
    found = {r["doc_id"]: r["taken"] for r in mixing.taken(docs, weight=heavy).collect()}
    # Certain copies of the heavy ones, up to three.
    assert all(found[i] == 9 for i in range(20))
