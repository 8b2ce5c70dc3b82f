import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listwright.functions.rules import TierRules
from listwright.operators import audits, scoring
from listwright.plans import pull as pl, report, score as sc
from listwright.sources.config import ConfigDocument
from listwright.sources.feeds import Feed
from listwright.sources.store import Store

GOOD = {
    "qualification_score": 70, "fit_score": 15, "class_year_eligible": True,
    "top_matches": ["a"], "top_gaps": ["b"], "fit_reasoning": "why", "summary": "so",
}


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


ANSWERS = [
    (json.dumps(GOOD), None),
    ("```\n" + json.dumps(GOOD) + "\n```", None),
    ("```json\n" + json.dumps(GOOD) + "\n``` tail", None),
    ("  \n" + json.dumps(GOOD, indent=2) + "\n", None),
    ("Here you go: " + json.dumps(GOOD), "not one JSON object"),
    (json.dumps(GOOD) + " thanks", "not one JSON object"),
    (json.dumps(GOOD) + "}", "not one JSON object"),
    (json.dumps(GOOD) + "]", "not one JSON object"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "not one JSON object"),
    (json.dumps([GOOD]), "not one JSON object"),
    ('"text"', "not one JSON object"),
    ("", "not one JSON object"),
    (None, "no response"),
    (json.dumps(without("summary")), None),
    (json.dumps(without("fit_reasoning")), None),
    *((json.dumps(without(k)), "missing field") for k in scoring.MANDATORY),
    *((json.dumps({**GOOD, "fit_score": v}), "score not an integer from 0 to 100")
      for v in (7.5, 7.0, "42", None, -1, 101, True, [1])),
    (json.dumps({**GOOD, "fit_score": 0, "qualification_score": 100}), None),
    (json.dumps({**GOOD, "top_gaps": None}), None),
    (json.dumps({**GOOD, "top_gaps": "none"}), "list field of another type"),
    (json.dumps({**GOOD, "class_year_eligible": None}), None),
]


def test_answers(spark):
    frame = spark.createDataFrame(
        [(str(i), "keyword", text, None) for i, (text, _) in enumerate(ANSWERS)],
        scoring.RESPONSE_SCHEMA,
    )
    parsed = scoring.parse_response(frame)
    rows = {int(r.job_id): r for r in parsed.collect()}
    for place, (text, error) in enumerate(ANSWERS):
        assert rows[place].error == error, text
    assert rows[0].qualification_score == 70 and rows[0].top_matches == ["a"]
    assert rows[0].summary == "so" and rows[13].summary is None
    eligibility = rows[len(ANSWERS) - 1]
    assert eligibility.class_year_eligible is False and rows[0].class_year_eligible is True
    counts = scoring.outcome_counts(parsed).first()
    assert counts.scored == sum(e is None for _, e in ANSWERS)
    assert counts.scored + counts.failed == len(ANSWERS)


def test_fences(apply):
    cases = {
        "x": "x", " x ": "x", "```x```": "x", "```json x```y```z```": "x", "``` json\n": "json",
        "```": "", "``````": "", "a```b```": "a```b```", " \n```json{}\n```\n": "{}",
    }
    assert apply(scoring.strip_fences, [(t,) for t in cases], "t string") == list(cases.values())


def test_insert_or_ignore(spark):
    stored = spark.createDataFrame([("a", 1), ("z", 1)], "k string, v int")
    batch = spark.createDataFrame(
        [("a", 5, 0), ("b", 6, 2), ("b", 7, 1), ("c", None, 0), ("d", 8, 0), ("d", 9, 0)],
        "k string, v int, s int",
    )
    added = scoring.insert_or_ignore(
        stored, batch, ("k",), F.struct("s", "v"), required=("v",)
    )
    assert {(r.k, r.v) for r in added.collect()} == {("b", 7), ("d", 8)}


def test_request_text(spark):
    template = scoring.RequestTemplate("do", "P", "R")
    frame = spark.createDataFrame(
        [("Acme", "Ops", ["a", "b"], "", None, "u")],
        "c string, t string, l array<string>, s string, p string, u string",
    )
    listing = scoring.render_listing(*(F.col(c) for c in frame.columns))
    text = frame.select(scoring.render_request(template, listing)).first()[0]
    assert text == (
        "do\n\nPROFILE\nP\n\nRESUME\nR\n\nLISTING\ncompany: Acme\ntitle: Ops\nlocations: a, b\n"
        "season: unspecified\nsponsorship: unspecified\nurl: u"
    )


def test_audits(spark):
    frame = spark.createDataFrame(
        [(0, 100), (4, 0), (5, 90), (24, 80), (25, 75), (45, 1), (65, 2), (85, 3), (100, 25),
         (-1, 0)],
        "qualification_score int, fit_score int",
    )
    q = F.col("qualification_score")
    bands = [r[0] for r in frame.select(audits.score_band(q)).collect()]
    assert bands == ["0-4", "0-4", "5-24", "5-24", "25-44", "45-64", "65-84", "85-100", "85-100",
                     None]
    rules = [("all", F.lit(True), 5, 20), ("none", F.lit(False), 0, 1), ("high", q > 50, 60, 85)]
    got = {r.family: r for r in audits.range_audit(frame, q, rules).collect()}
    assert (got["all"].covered, got["all"].outside, got["all"].above) == (10, 9, 6)
    assert got["none"].outside_share is None
    assert (got["high"].outside, got["high"].outside_share) == (1, 0.333333)
    titled = spark.createDataFrame(
        [("Quantitative Researcher", 50), ("SWE Intern", 20), ("Strategy Intern", 70),
         ("AI Research Intern", 60), ("FPGA", 10), ("Defense Software", 30), ("Insights", 41)],
        "title string, s int",
    )
    roles = audits.range_audit(titled, F.col("s"), audits.role_rules(F.col("title"))).collect()
    assert [(r.covered, r.outside) for r in roles] == [
        (1, 1), (1, 0), (1, 0), (1, 1), (1, 0), (1, 0), (1, 1),
    ]
    split = audits.axis_split(frame).first()
    assert (split.wanted_not_qualified, split.qualified_not_wanted) == (4, 2)
    cluster = audits.cluster_share(frame, bounds=(65, 100)).first()
    assert (cluster.clustered, cluster.share) == (3, 0.3)
    assert audits.cluster_share(frame.limit(0)).first().share is None


# --- the whole scoring run ------------------------------------------------------------------------

PROFILE, RESUME = ConfigDocument.of(b"likes: tea"), ConfigDocument.of(b"did: things")
RULES = TierRules(named=("acme",), keywords=(r"\bops\b",), skips=(r"\bswe\b",))


def run_with(**kwargs):
    settings = {"rules": RULES, "preset": "all", "chunks": 3, **kwargs}
    return sc.ScoreRun(PROFILE, RESUME, "rule-scorer", **settings)


def scorer(calls_dir, failing=()):
    """Scores by title; every call leaves a file, so that calls can be counted across processes."""

    def factory():
        import json as js
        import os
        import uuid

        def answer(request):
            title = request.split("title: ")[1].split("\n")[0]
            open(os.path.join(calls_dir, f"{title} {uuid.uuid4().hex}"), "w").close()
            if title in failing:
                raise TimeoutError("slow")
            number = int(title.split("#")[1])
            return js.dumps({
                "qualification_score": number, "fit_score": 90 - number,
                "class_year_eligible": 1, "top_matches": [], "top_gaps": ["x"], "summary": title,
            })

        return answer

    return factory


@pytest.fixture
def store(spark, tmp_path):
    listings = [
        {"id": str(i), "company_name": "Acme" if i % 2 else "Bolt", "title": f"Ops #{i}",
         "url": f"https://x.test/{i}", "season": "Summer 2027", "date_posted": 100 + i}
        for i in range(12)
    ] + [{"id": "s", "company_name": "Bolt", "title": "SWE #1", "url": "u", "season": "Summer"},
         {"id": "n", "company_name": "Acme", "title": "Ops #50", "url": "u"}]
    (tmp_path / "feed.json").write_text(json.dumps(listings))
    made = Store(spark, str(tmp_path / "store"))
    pl.pull(made, [Feed("one", str(tmp_path / "feed.json"))], datetime(2024, 5, 1))
    (tmp_path / "calls").mkdir()
    return made


def calls(tmp_path):
    return sorted(p.name.rsplit(" ", 1)[0] for p in (tmp_path / "calls").iterdir())


def test_scoring_run_calls_once_per_queued_job_and_resumes(store, tmp_path):
    bad = ("Ops #3", "Ops #4")
    preview = sc.dry_run(store, run_with()).collect()
    assert len(preview) == 12 and preview[0].title == "Ops #11"
    done = sc.score(store, run_with(), scorer(str(tmp_path / "calls"), bad))
    assert (done.queued, done.scored, done.failed) == (12, 10, 2)
    # SWE and the listing without a season never reach the scorer.
    assert calls(tmp_path) == sorted(f"Ops #{i}" for i in range(12))
    dead = {r.error for r in store.read("dead_scores").collect()}
    assert dead == {"TimeoutError: slow"}
    # Second run: only the failed ones.
    again = sc.score(store, run_with(), scorer(str(tmp_path / "calls")))
    assert (again.queued, again.scored, again.failed) == (2, 2, 0)
    assert len(calls(tmp_path)) == 14
    assert sc.score(store, run_with(), scorer(str(tmp_path / "calls"))).queued == 0
    scores = store.read("match_scores")
    assert scores.count() == scores.select(*scoring.SCORE_KEY).distinct().count() == 12
    # A changed document makes everything due again.
    other = sc.ScoreRun(ConfigDocument.of(b"likes: tea!"), RESUME, "m", "tier1", RULES, limit=2)
    newer = sc.score(store, other, scorer(str(tmp_path / "calls")), datetime(2099, 1, 1))
    assert newer.queued == 2
    latest = report.latest_profile(store).first().profile_version
    assert latest == other.profile.version != PROFILE.version
    assert report.review_frame(store).count() == 14
    assert report.review_frame(store, latest_only=True).count() == 2


def test_run_that_dies_keeps_its_finished_chunks(store, tmp_path, monkeypatch):
    real, seen = sc._score_chunk, []

    def die_on_second(*args):
        if seen:
            raise KeyboardInterrupt
        seen.append(1)
        return real(*args)

    monkeypatch.setattr(sc, "_score_chunk", die_on_second)
    with pytest.raises(KeyboardInterrupt):
        sc.score(store, run_with(), scorer(str(tmp_path / "calls")))
    monkeypatch.undo()
    kept = store.read("match_scores").count()
    assert 0 < kept < 12
    done = sc.score(store, run_with(), scorer(str(tmp_path / "calls")))
    assert done.queued == 12 - kept
    assert len(calls(tmp_path)) == 12


def test_versions_that_look_like_numbers_stay_texts(store, tmp_path):
    run = sc.ScoreRun(
        ConfigDocument("a", "00000012e500"), ConfigDocument("b", "000000000001"), "m", "all", RULES
    )
    sc.score(store, run, scorer(str(tmp_path / "calls")))
    row = store.read("match_scores").first()
    assert (row.profile_version, row.resume_version) == ("00000012e500", "000000000001")
    assert sc.score(store, run, scorer(str(tmp_path / "calls"))).queued == 0


def test_reports_over_a_store(store, tmp_path):
    sc.score(store, run_with(), scorer(str(tmp_path / "calls")), datetime(2024, 5, 2))
    frame = report.review_frame(store)
    assert frame.count() == 12
    row = frame.filter("title = 'Ops #11'").first()
    assert (row.company, row.locations, row.ats, row.combined) == ("Acme", "—", "unknown", 90)
    assert report.winners(store).count() == 0
    lines = [r.line for r in report.report_lines(frame.filter("q_score = 5")).collect()]
    assert lines == ["Acme" + " " * 22 + "Ops #5" + " " * 40 + "  5  85"]


def test_config_document_is_read_as_bytes(spark, tmp_path):
    (tmp_path / "profile.yaml").write_bytes("naïve: yes\r\n".encode())
    document = ConfigDocument.load(spark, str(tmp_path / "profile.yaml"))
    assert document == ConfigDocument.of("naïve: yes\r\n".encode())
