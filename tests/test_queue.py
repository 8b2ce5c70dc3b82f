import pytest
from pyspark.sql import functions as F

from listwright.functions.rules import TierRules
from listwright.operators import queue as q

RULES = TierRules(named=("acme",), keywords=(r"\bops\b",), skips=(r"\bswe\b",))


@pytest.fixture(scope="module")
def tables(spark):
    seasons = [None, "", "N/A", "n/a", "Summer", "Summer 2027", "Winter 2026", "20275"]
    jobs = [
        (f"j{i:02d}", "c1" if i % 2 else "c2", "Ops" if i % 3 else "SWE", ["NYC"], s, None,
         f"https://x.test/{i}", None if i == 5 else 1000 - i, i != 2)
        for i, s in enumerate(seasons * 4)
    ]
    jobs = spark.createDataFrame(
        jobs, "job_id string, company_id string, title string, locations array<string>, "
        "season string, sponsorship string, url string, posted_at long, active boolean",
    )
    companies = spark.createDataFrame(
        [("c1", "Acme"), ("c2", "Bolt"), ("c3", "None")], "company_id string, name string"
    )
    scores = spark.createDataFrame(
        [("j04", "p1", "r1"), ("j05", "p2", "r1"), ("j12", "p1", "r2"), ("j13", "p1", "r1")],
        "job_id string, profile_version string, resume_version string",
    )
    return jobs, companies, scores


def ids(frame):
    return {r.job_id for r in frame.collect()}


def test_candidates_need_activity_and_an_open_season(tables):
    jobs, _, _ = tables
    assert {r.season for r in q.candidates(jobs, "2027").collect()} == {
        "N/A", "Summer", "Summer 2027", "20275",
    }
    assert "j02" not in ids(q.candidates(jobs, "2027"))


def test_latest_candidate_leaves_out_unstated_seasons(tables):
    jobs, _, _ = tables
    only = q.latest_candidate(jobs, "2027").collect()
    assert [r.job_id for r in only] == ["j04"]


def test_score_under_other_versions_does_not_count(tables):
    jobs, _, scores = tables
    left = ids(q.unscored(jobs, scores, "p1", "r1"))
    assert {"j04", "j13"} & left == set()
    assert {"j05", "j12"} <= left
    assert ids(q.unscored(jobs, scores, "p3", "r1")) == ids(jobs)


def built(tables, **kwargs):
    return q.build_queue(*tables, "p1", "r1", rules=RULES, cycle="2027", **kwargs)


def test_queue_has_no_scored_job_and_only_the_wanted_tiers(tables):
    for preset, wanted in (("tier1", {"named_target"}), ("tier2", {"keyword"})):
        rows = built(tables, preset=preset).collect()
        assert {r.tier for r in rows} == wanted
        assert not {r.job_id for r in rows} & {"j04", "j13"}


@pytest.mark.parametrize("limit", [None, 0, 1, 3, 999])
def test_limit_is_applied_after_the_exclusion(tables, limit):
    everything = built(tables, preset="all").collect()
    expected = sorted(
        everything, key=lambda r: (r.posted_at is None, -(r.posted_at or 0), r.job_id)
    )
    taken = built(tables, preset="all", limit=limit)
    got = sorted(
        taken.collect(), key=lambda r: (r.posted_at is None, -(r.posted_at or 0), r.job_id)
    )
    assert got == (expected[:limit] if limit else expected)


@pytest.mark.parametrize("size,hidden", [(0, 0), (20, 0), (21, 1)])
def test_preview(spark, size, hidden):
    queue = spark.range(size).select(
        F.format_string("j%03d", "id").alias("job_id"), F.lit("keyword").alias("tier"),
        F.col("id").alias("posted_at"),
    )
    rows = q.preview(queue).collect()
    assert len(rows) == (min(size, 20) or 1)
    assert {(r.queue_size, r.not_shown) for r in rows} == {(size, hidden)}
    assert rows[0].posted_at == (size - 1 if size else None)


def test_plan_shapes(tables):
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    assert "LeftAnti" in plan(built(tables, preset="all"))
    assert "TakeOrderedAndProject" in plan(built(tables, preset="all", limit=3))
    assert "CartesianProduct" not in plan(q.preview(built(tables)))
    assert "NestedLoop" not in plan(q.preview(built(tables)))
