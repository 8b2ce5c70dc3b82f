import random
import re

import pytest

from listwright.llm import quality

SCHEMA = "doc_id long, text string"
PROSE = "The committee met again on the following day and heard from every member who had asked to speak about the plan. " \
        "Nobody objected, though several wished for more time, and a few of them said so at length before the vote was taken. " \
        "In the end it passed, and the chair thanked them all for their patience and their work."


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def slow(text):
    own = words(text)
    seen = {}
    for i in range(len(own) - 2):
        seen.setdefault(tuple(own[i:i + 3]), []).append(i)
    hit = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(own) < 50 or 100 * len(hit) > 50 * len(own)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_like_counting_by_hand(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 5000, PROSE, PROSE + "\n" + PROSE]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "b", "É", "#", "*", "🙂", " ", " ", "\n", "\r", "\u00a0"]) for _ in range(rng.randrange(200))))
    rows = quality.statistics(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    assert found == {i: slow(t) for i, t in enumerate(texts)}


def kept(spark, *texts):
    rows = quality.statistics(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    return [r["kept"] for r in rows]


def test_prose_stays_and_junk_goes(spark):
    shout = " ".join(w.upper() + "!!" for w in PROSE.split())
    marks = " ".join(w + "***" for w in PROSE.split())
    table = " | ".join(PROSE.split())
    menu = "\n".join(f"Menu entry number {i}" for i in range(20))
    assert kept(spark, PROSE, shout, marks, table, menu, None, PROSE + "\n" + "All rights reserved.", PROSE + "\n" + shout + shout) == [
        True, False, False, False, False, False, True, False]


def test_cleaned_text_keeps_good_lines(spark):
    rows = [(1, f"Home | About | Contact | Us\n{PROSE}\n\nLicensed under the MIT License."), (2, None), (3, "")]
    found = {r["doc_id"]: (r["text"], r["kept"]) for r in quality.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: (f"{PROSE}\n", True), 2: (None, False), 3: ("", False)}


def test_empty_table(spark):
    assert quality.statistics(spark.createDataFrame([], SCHEMA)).count() == 0
