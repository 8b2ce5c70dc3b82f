import json
import random
from urllib.parse import unquote

import pytest

from listwright.sources.arrays import fragments, read_arrays
from listwright.sources.elements import element_texts


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes, so that every file is read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def value(rng, depth=0):
    texts = ["", "plain", 'quo"te', "back\\slash", "brace } and ] in text", '{"a":[1,2}', "é\U0001f600", "\\", '\\"', "a,b", "\n"]
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(texts)
    if kind == 2:
        return rng.randint(-5, 5)
    if kind == 3:
        return rng.choice([None, True, 1.5])
    if kind < 6:
        return {rng.choice(texts) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def array_file(rng):
    elements = [value(rng, 0) if rng.random() < 0.3 else {"n": i, "v": value(rng, 1)} for i in range(rng.randint(0, 40))]
    return elements, json.dumps(elements, indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5)


def read(spark, path):
    found = {}
    for row in read_arrays(spark, str(path)).collect():
        found.setdefault(row["file"].rsplit("/", 1)[1], []).append((row["feed_status"], row["pos"], row["payload"]))
    found = {unquote(name): rows for name, rows in found.items()}
    return {name: sorted(rows, key=lambda r: (r[1] is not None, r[1])) for name, rows in found.items()}


@pytest.mark.parametrize("size", [11, 1 << 20])
def test_elements_and_places_are_those_of_the_whole_file(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    expected = {}
    for i in range(5):
        elements, text = array_file(rng)
        (tmp_path / f"a {i}%20.json").write_text(text, encoding="utf-8")
        expected[f"a {i}%20.json"] = elements
    small_ranges(size)
    found = read(spark, tmp_path)
    assert set(found) == set(expected)
    for name, elements in expected.items():
        rows = found[name]
        assert {r[0] for r in rows} == {"ok"}
        if not elements:
            assert rows == [("ok", None, None)]
            continue
        assert [r[1] for r in rows] == list(range(len(elements)))
        assert [None if r[2] is None else json.loads(r[2]) for r in rows] == elements


BROKEN = [
    "", " ", "{}", '{"listings": []}', '[{"id": "1"', '[{"id": "1"}', '[{"id": "1"}] and more', '[{"id": "1"}]}', "[1]}", "[",
    "]", '[{"a":1},]', '[,{"a":1}]', '[{"a":1} {"b":2}]', '[{"a":1}],[{"b":2}]', '[{"a":1}] , {"b":2}]', '[{"a":[1}]', '[{"a":1]}',
    '["}', '[{"a":"}]', '[{"a":1}}]', '[{"a":1},{"b":tru}]', "[1,2,,3]", '[{"a":1},{"b":2}', '{"a":1}', '[{"a":1}[{"b":2}]]', "null",
    '[{"a":"x""}]', '[{"a":1},3',
]
WHOLE = ["[]", " [ ] ", "[1,2]", '["}"]', '[{"a":"}"}]', '\n[\n{"a":1}\n,\n{"b":{"c":{}}}\n]\n', '[[{"a":1}],[{"b":2}]]', '[{"a":1},3,"x}",[]]',
         '[{}]', '[{},{}]', '[{"a":"\\\\"},{"b":"\\""}]']


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_a_file_fails_where_a_reader_of_whole_files_fails(spark, tmp_path, small_ranges, size):
    texts = {f"a {i}%20.json": text for i, text in enumerate(BROKEN + WHOLE)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    documents = spark.createDataFrame(list(texts.items()), "file string, document string")
    whole = {r["file"]: r["elements"] for r in element_texts(documents, "file").collect()}
    assert [whole[f"a {i}%20.json"] is None for i in range(len(texts))] == [True] * len(BROKEN) + [False] * len(WHOLE)
    small_ranges(size)
    found = read(spark, tmp_path)
    assert set(found) == set(texts)
    for name, elements in whole.items():
        if elements is None:
            assert found[name] == [("failed", None, None)], texts[name]
        elif not elements:
            assert found[name] == [("ok", None, None)], texts[name]
        else:
            assert [r[0] for r in found[name]] == ["ok"] * len(elements)
            assert [r[1:] for r in found[name]] == list(enumerate(elements)), texts[name]


def test_one_file_is_read_by_many_tasks_and_text_moves_once(spark, tmp_path, small_ranges):
    (tmp_path / "one.json").write_text(json.dumps([{"n": i, "text": "[{\"x\"" * 5} for i in range(2000)]))
    small_ranges(4000)
    cut = fragments(spark.read.option("lineSep", "}").text(str(tmp_path)))
    assert cut.select("block").distinct().count() > 10
    rows = read(spark, tmp_path)["one.json"]
    assert [json.loads(r[2])["n"] for r in rows] == [r[1] for r in rows] == list(range(2000))


def test_missing_paths_are_told_at_once(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_arrays(spark, str(tmp_path / "none.json"))
