import json

import pytest
from pyspark.sql import functions as F

from listwright.operators import normalize as nz
from listwright.sources.feeds import Feed, feed_status, land_as_lines, read_feeds


def entry(**fields):
    base = {"id": "1", "company_name": "Acme", "title": "Intern", "url": "https://x.test/1"}
    return {k: v for k, v in {**base, **fields}.items() if v is not ...}


CASES = [
    # (object, verdict, expected values of a kept listing)
    (entry(), "kept", {"active": True, "locations": [], "degrees": [], "season": None}),
    (entry(is_visible=None), "skipped", {}),
    (entry(is_visible=False), "skipped", {}),
    (entry(is_visible=0), "skipped", {}),
    (entry(is_visible=0.0), "skipped", {}),
    (entry(is_visible=""), "skipped", {}),
    (entry(is_visible=[]), "skipped", {}),
    (entry(is_visible={}), "skipped", {}),
    (entry(is_visible=True), "kept", {}),
    (entry(is_visible="false"), "kept", {}),
    (entry(is_visible=[None]), "kept", {}),
    (entry(is_visible=0.5), "kept", {}),
    (entry(active=None), "kept", {"active": False}),
    (entry(active=False), "kept", {"active": False}),
    (entry(active=True), "kept", {"active": True}),
    (entry(active="no"), "kept", {"active": True}),
    (entry(id=""), "skipped", {}),
    (entry(id=0), "skipped", {}),
    (entry(id=...), "skipped", {}),
    (entry(id=17), "kept", {"source_id": "17"}),
    (entry(id=["x"]), "bad", {}),
    (entry(title="   "), "kept", {"title": ""}),
    (entry(title=""), "skipped", {}),
    (entry(title=None), "skipped", {}),
    (entry(title=5), "bad", {}),
    (entry(title="  Data ", company_name="\tAcme\n"), "kept",
     {"title": "Data", "company_name": "Acme"}),
    (entry(company_name=["a"]), "bad", {}),
    (entry(url=...), "skipped", {}),
    (entry(season="Summer", terms=["Fall"]), "kept", {"season": "Summer"}),
    (entry(season="", terms=["Fall", "Winter"]), "kept", {"season": "Fall"}),
    (entry(season=None, terms=["Fall"]), "kept", {"season": "Fall"}),
    (entry(terms=[]), "kept", {"season": None}),
    (entry(terms=["", "Fall"]), "kept", {"season": ""}),
    (entry(season=""), "kept", {"season": None}),
    (entry(locations=["NYC", "SF"]), "kept", {"locations": ["NYC", "SF"]}),
    (entry(locations=None, degrees=None), "kept", {"locations": [], "degrees": []}),
    (entry(locations=["NYC", None]), "bad", {}),
    (entry(locations="NYC"), "bad", {}),
    (entry(locations=["NYC", 5]), "bad", {}),
    (entry(locations=[["NYC"]]), "bad", {}),
    (entry(degrees=["BS", None]), "kept", {"degrees": ["BS", None]}),
    (entry(degrees="BS"), "bad", {}),
    (entry(date_posted=1700000000, date_updated=None), "kept",
     {"posted_at": 1700000000, "updated_at": None}),
    (entry(company_url=""), "kept", {"company_url": None}),
    (entry(company_url="https://a.test"), "kept", {"company_url": "https://a.test"}),
    (entry(category="AI", sponsorship=None), "kept", {"category": "AI", "sponsorship": None}),
    (entry(new_field={"deep": [1, {"x": None}]}), "kept", {}),
    (entry(title='quote " slash \\ é  '), "kept", {"title": 'quote " slash \\ é'}),
    (None, "bad", {}),
    (5, "bad", {}),
    ("text", "bad", {}),
    (json.dumps(entry()), "bad", {}),
    (entry(season=["s"]), "bad", {}),
    (entry(category={"a": 1}), "bad", {}),
    (entry(sponsorship=["x"]), "bad", {}),
    (entry(date_posted="abc"), "bad", {}),
    (entry(date_updated=1.9), "bad", {}),
    (["list"], "bad", {}),
]


@pytest.fixture(scope="module")
def feed_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("feeds")
    (root / "one.json").write_text(json.dumps([c for c, _, _ in CASES], indent=1))
    (root / "object.json").write_text('{"listings": []}')
    (root / "broken.json").write_text('[{"id": "1"')
    (root / "trailing.json").write_text('[{"id": "1"}] and more')
    (root / "empty.json").write_text("[]")
    (root / "two.json").write_text(json.dumps([entry(id="2"), entry(id="3")]))
    (root / "lines.jsonl").write_text("\n".join([
        json.dumps({"pos": 0, "listing": entry(id="4")}),
        json.dumps({"pos": 1, "listing": entry(id="5", is_visible=False)}),
        "{not json",
    ]))
    return root


def registry(root):
    return [
        Feed("one", str(root / "one.json")),
        Feed("object", str(root / "object.json")),
        Feed("broken", str(root / "broken.json")),
        Feed("trailing", str(root / "trailing.json")),
        Feed("missing", str(root / "missing.json")),
        Feed("empty", str(root / "empty.json")),
        Feed("two", str(root / "two.json")),
        Feed("lines", str(root / "lines.jsonl"), layout="lines"),
    ]


@pytest.fixture(scope="module")
def judged(spark, feed_dir):
    return nz.normalize(read_feeds(spark, registry(feed_dir)), 1)


def test_every_object_gets_its_verdict_and_values(judged):
    rows = {r.seq.pos: r for r in judged.filter("source = 'one'").collect()}
    assert len(rows) == len(CASES)
    for place, (raw, verdict, values) in enumerate(CASES):
        assert rows[place].verdict == verdict, (raw, rows[place].reason)
        for name, value in values.items():
            assert rows[place][name] == value, (raw, name)


def test_payload_survives_whole(judged):
    rows = judged.filter("source = 'one' AND verdict = 'kept'").collect()
    for row in rows:
        assert json.loads(row.raw_payload) == CASES[row.seq.pos][0]


def test_failed_feeds_do_not_stop_the_others(spark, feed_dir):
    status = feed_status(read_feeds(spark, registry(feed_dir))).orderBy("source_ord").collect()
    assert [(r.source, r.status, r.listings) for r in status] == [
        ("one", "ok", len(CASES)), ("object", "failed", 0), ("broken", "failed", 0),
        ("trailing", "failed", 0), ("missing", "failed", 0), ("empty", "ok", 0), ("two", "ok", 2),
        ("lines", "ok", 3),
    ]


def test_counts_add_up(judged):
    counts = {r.source: r for r in nz.verdict_counts(judged).collect()}
    expected = [v for _, v, _ in CASES]
    one = counts["one"]
    assert (one.kept, one.skipped, one.bad) == tuple(
        expected.count(v) for v in ("kept", "skipped", "bad")
    )
    assert all(r.kept + r.skipped + r.bad == r.total for r in counts.values())
    assert (counts["lines"].kept, counts["lines"].skipped, counts["lines"].bad) == (1, 1, 1)
    assert counts["missing"].total == counts["empty"].total == 0


def test_arrival_order_follows_registry_then_file_place(judged):
    kept = judged.filter("verdict = 'kept'")
    first = nz.first_row(kept, F.col("seq"), "raw_payload").first()
    assert first.source == "one" and first.seq.pos == 0 and "raw_payload" not in first
    last = kept.orderBy(F.desc("seq")).first()
    assert last.source == "lines"


def test_most_common_counts_null_and_breaks_ties_by_arrival(spark):
    rows = spark.createDataFrame(
        [(1, "b"), (2, None), (3, "a"), (4, None), (5, "a"), (6, "b"), (7, "c")],
        "seq int, season string",
    )
    top = nz.most_common(rows, "season", F.col("seq"), 3).collect()
    assert [(r.season, r.n) for r in top] == [("b", 2), (None, 2), ("a", 2)]


def test_landed_lines_give_the_same_listings(spark, feed_dir, tmp_path):
    raw = read_feeds(spark, [Feed("one", str(feed_dir / "two.json"))])
    land_as_lines(raw, str(tmp_path / "landed"))
    landed = read_feeds(spark, [Feed("one", str(tmp_path / "landed"), layout="lines")])

    def listings(rows):
        kept = nz.normalize(rows, 1).withColumn("pos", F.col("seq.pos")).drop("seq")
        return sorted(map(str, kept.collect()))

    assert listings(raw) == listings(landed) != []


def test_parsing_happens_once_per_payload(judged):
    plan = judged.filter("verdict = 'kept'")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    # from_json of the payload: once per feed in the union, never repeated in a filter.
    assert plan.count("from_json(StructField(id") <= 8


def test_bare_lines_and_half_envelopes_are_bad(spark, tmp_path):
    bare = [entry(id="7", title=f"t{i}") for i in range(3)]
    rows = [*bare, {"pos": 3}, {"listing": entry()}, {"pos": 5, "listing": entry(id="8")}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    raw = read_feeds(spark, [Feed("one", str(tmp_path / "a.jsonl"), layout="lines")])
    found = nz.normalize(raw, 1).select("verdict", "source_id", "raw_payload").collect()
    assert sorted(r.verdict for r in found) == ["bad"] * 5 + ["kept"]
    texts = {json.loads(r.raw_payload) for r in found if r.verdict == "bad"}
    assert texts == {json.dumps(row) for row in rows[:5]}
