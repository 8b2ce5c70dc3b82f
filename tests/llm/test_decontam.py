import random

import pytest

from listwright.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in "".join(
        c if not c.isascii() or c.isalnum() else " " for c in text or "")).split(" ")


def words(text):
    return [w for w in fold(text) if w]


def slow(docs, items, width=13):
    found = []
    for doc_id, text in docs:
        own, hit, held = words(text), set(), set()
        for item_id, passage in items:
            item = words(passage)
            n = min(width, len(item))
            for i in range(len(item) - n + 1 if item else 0):
                for j in range(len(own) - n + 1):
                    if own[j:j + n] == item[i:i + n]:
                        hit.update(range(j, j + n))
                        if item_id is not None:
                            held.add(str(item_id))
        found.append((doc_id, len(own), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(found, key=str)


def judged(spark, docs, items):
    frame = decontam.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_comparing_all(spark, seed):
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice(["the", "of", "a", "É", "x1", "and", "to"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 12, 13, 14, 30]) if i else 20)) for i in range(6)]
    docs = [(i, text(rng.randrange(40))) for i in range(20)]
    for i in range(20, 40):
        passage = rng.choice(items)[1].split()
        at = rng.randrange(len(passage))
        docs.append((i, f"{text(9)}, {' '.join(passage[at // 3:])}! {text(rng.randrange(300))}"))
    docs += [(40, items[0][1].upper()), (41, items[0][1] * 2), (41, items[0][1] * 2)]
    assert judged(spark, docs, items) == slow(docs, items)


def test_nulls_empties_and_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = [(10, passage), (9, passage), (9, passage), (None, passage), (8, None), (7, " ., "), (6, "Zwei Wörter")]
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, f"x {passage} y"), (4, "zwei WÖRTER"), (5, "zwei, wörter"),
            (6, " ".join(f"w{i}" for i in range(12)))]
    assert judged(spark, docs, items) == slow(docs, items)


def test_empty_tables(spark):
    assert judged(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    assert judged(spark, [], [(1, "a b")]) == []


def test_contaminated_documents_go_with_all_columns(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    filler = " ".join(f"v{i}" for i in range(500))
    docs = spark.createDataFrame([(1, passage, "a"), (2, filler, "b"), (3, f"{filler} {passage}", "c"), (4, None, "d"), (None, passage, "e")],
                                 "doc_id long, text string, mark string")
    kept = decontam.decontaminated(docs, spark.createDataFrame([(1, passage)], ITEMS))
    assert sorted(r["mark"] for r in kept.collect()) == ["b", "c", "d"] and kept.columns == docs.columns


def test_small_bitmap_changes_nothing(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, "d e f g")], DOCS)
    known = decontam.window_shingles(decontam.item_windows(spark.createDataFrame([(1, passage)], ITEMS)))
    known = known.select("shingle", "width", "h").distinct().withColumn("id", known["h"])
    wide = decontam.document_shingles(docs, known).collect()
    assert sorted(wide) == sorted(decontam.document_shingles(docs, known, bits=64).collect()) and len(wide) == 18
