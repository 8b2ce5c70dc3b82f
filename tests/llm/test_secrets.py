import hashlib
import random

from listwright.llm import secrets

SCHEMA = "doc_id long, text string, source string"


def corpus():
    rng = random.Random(3)
    common = [a + b for a in ("station", "harbour", "garden", "winter", "letter") for b in ("", "s", "ing", "master")]
    docs, truth = [], {}
    for i in range(300):
        text = [rng.choice(common) for _ in range(40)]
        kind = i % 6
        digits = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        found = {0: f"password={digits[:18]}", 1: f'"{digits}"', 2: "AKIA" + "".join(rng.choice("ABCDEFGHJK234567") for _ in range(16)),
                 3: "".join(rng.choice("0123456789") for _ in range(16)), 4: "stationmaster2harbours", 5: "garden-station-winter2-letters"}[kind]
        text[20:20] = ["token", "=", found] if kind == 1 else [found]
        docs.append((i, " ".join(text), "src0"))
        truth[i] = kind < 3
    return docs, truth


def test_secrets_are_told_from_the_rest(spark):
    docs, truth = corpus()
    rows = secrets.scanned(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"]: r["is_secret"] for r in rows} == truth and len(rows) == 300
    first = next(r for r in rows if r["doc_id"] == 0)
    value = docs[0][1].split()[20].removeprefix("password=")
    assert (first["place"], first["length"], first["digest"]) == (20, 18, hashlib.sha256(value.encode()).hexdigest())
    assert {r["detector"] for r in rows if r["doc_id"] % 6 == 2} == {"aws"}


def test_nulls_empties_repeats_and_clashing_columns(spark):
    key = "AKIA" + "A2B3C4D5" * 2
    rows = [(None, f"x {key}.", None, 1), (1, None, "a", 2), (2, "", "b", 3), (3, f"'{key}'", "c", 4), (3, f"'{key}'", "c", 4), (4, "w" * 200_000, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, value int")
    found = secrets.scanned(docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["3", "3", "None"] and all(r["is_secret"] for r in found)
    assert secrets.scanned(docs.limit(0)).count() == 0
    assert secrets.scanned(docs.drop("source")).count() == 3


def test_every_run_of_a_word_is_a_candidate(spark):
    a, b, c = "A2b3C4d5" * 5, "f0e1d2c3" * 4, "9z8y7x6w" * 3
    texts = [f'token = "{a}"!!', f'token = "{a}"###', f'x user={a};password="{b}"?', f"{a}|{b}&{c}~ 7", "!" * 200_000 + b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["place"], r["piece"]): r["value"] for r in secrets.candidates(docs).collect()}
    assert found == {
        (0, 2, 0): a, (1, 2, 0): a, (2, 1, 1): a, (2, 1, 3): b, (3, 0, 0): a, (3, 0, 1): b, (3, 0, 2): c, (4, 0, 0): b,
    }
    rows = secrets.scanned(docs).collect()
    assert sorted(r["digest"] for r in rows) == sorted(hashlib.sha256(v.encode()).hexdigest() for v in found.values())


def test_a_run_is_assigned_by_the_run_before_it(spark):
    a, b = "A2b3C4d5" * 5, "f0e1d2c3" * 4
    docs = spark.createDataFrame([(1, f"user={a};password='{b}',{a} 7")], "doc_id long, text string")
    rows = secrets.described(secrets.candidates(docs), secrets.common_trigrams(docs)).collect()
    assert {r["piece"]: (r["assigned"], r["after_digits"]) for r in rows} == {1: (0.0, 0.0), 3: (1.0, 0.0), 4: (0.0, 1.0)}
