"""Tiering, queue and scoring on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright.catalog import adapters as ad
from listwright.catalog.adapters import (
    COMPANIES_SQL, CYCLE, JOBS_SQL, ORDER_RULES, ORDER_TIER_SQL, PART_KEYWORD, PART_NAMED,
    PART_RULES, PART_SKIP, PART_TIER_SQL, PARTS_SQL, SCORES_SQL, sql_strip,
)
from listwright.catalog.registry import query, table
from listwright.operators import audits, queue as q, scoring, tiering

# --- tiers ---------------------------------------------------------------------------------------


@query("tier_named", f"""
WITH {PARTS_SQL} SELECT p_partkey, regexp_matches(company_name, '{PART_NAMED}') AS is_named
FROM parts
""")
def tier_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.parts_as_listings(spark, sf_dir).select(
        "p_partkey", PART_RULES.is_named(F.col("company_name")).alias("is_named")
    )


@query("tier_skip", f"""
WITH {PARTS_SQL} SELECT p_partkey, regexp_matches(title, '{PART_SKIP}') AS is_skipped FROM parts
""")
def tier_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.parts_as_listings(spark, sf_dir).select(
        "p_partkey", PART_RULES.is_skipped(F.col("title")).alias("is_skipped")
    )


@query("tier_keyword", f"""
WITH {PARTS_SQL}
SELECT p_partkey, regexp_matches(company_name || ' ' || title, '{PART_KEYWORD}') AS is_keyword
FROM parts
""")
def tier_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.parts_as_listings(spark, sf_dir).select(
        "p_partkey",
        PART_RULES.is_keyword(F.col("company_name"), F.col("title")).alias("is_keyword"),
    )


def _tiered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.with_tier(ad.parts_as_listings(spark, sf_dir), PART_RULES)


@query("tier_classify", f"WITH {PARTS_SQL} SELECT p_partkey, {PART_TIER_SQL} AS tier FROM parts")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered_parts(spark, sf_dir).select("p_partkey", "tier")


@query("tier_counts", f"""
WITH {PARTS_SQL} SELECT {PART_TIER_SQL} AS tier, count(*) AS n FROM parts GROUP BY 1
""")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.tier_counts(_tiered_parts(spark, sf_dir))


@query("tier_subset", f"""
WITH {PARTS_SQL}, tiered AS (SELECT *, {PART_TIER_SQL} AS tier FROM parts)
SELECT 'tier1' AS preset, p_partkey, tier FROM tiered WHERE tier = 'named_target'
UNION ALL SELECT 'tier2', p_partkey, tier FROM tiered WHERE tier = 'keyword'
UNION ALL SELECT 'all', p_partkey, tier FROM tiered WHERE tier <> 'skip'
""")
def tier_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiered = _tiered_parts(spark, sf_dir)

    def chosen(preset: str) -> DataFrame:
        return tiering.in_tiers(tiered, preset).select(
            F.lit(preset).alias("preset"), "p_partkey", "tier"
        )

    return chosen("tier1").unionByName(chosen("tier2")).unionByName(chosen("all"))


@query("tier_matched_terms", f"""
WITH {PARTS_SQL}, tiered AS (SELECT *, {PART_TIER_SQL} AS tier FROM parts)
SELECT p_partkey, array_to_string(list_transform(CASE tier
  WHEN 'named_target' THEN regexp_extract_all(company_name, '{PART_NAMED}')
  WHEN 'keyword' THEN regexp_extract_all(company_name || ' ' || title, '{PART_KEYWORD}')
  ELSE regexp_extract_all(title, '{PART_SKIP}') END, lambda x: lower(x)), '|') AS matched_terms
FROM tiered
""")
def tier_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiering.with_matched_terms(ad.parts_as_listings(spark, sf_dir), PART_RULES)
    return rows.select("p_partkey", F.array_join("matched_terms", "|").alias("matched_terms"))


# --- queue ---------------------------------------------------------------------------------------

_IS_CANDIDATE = f"active AND (season LIKE '%{CYCLE}%' OR season IN ('Summer', 'N/A'))"
_QUEUE_SQL = f"""{JOBS_SQL}, {COMPANIES_SQL},
queue AS (
  SELECT j.job_id, name AS company_name, title, posted_at, {ORDER_TIER_SQL} AS tier
  FROM jobs j JOIN companies USING (company_id)
  WHERE {_IS_CANDIDATE}
    AND {ORDER_TIER_SQL} IN ('named_target', 'keyword')
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = j.job_id
      AND l.l_returnflag = 'A' AND l.l_linestatus = 'F')
)"""


def _scored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("profile_version"),
        F.col("l_linestatus").alias("resume_version"),
    )


def _queue(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return q.build_queue(
        ad.jobs_of_orders(spark, sf_dir), ad.companies_of_customers(spark, sf_dir),
        _scored_jobs(spark, sf_dir), "A", "F", "all", ORDER_RULES, limit, CYCLE,
    )


@query("candidate_filter", f"WITH {JOBS_SQL} SELECT job_id, season FROM jobs WHERE {_IS_CANDIDATE}")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.candidates(ad.jobs_of_orders(spark, sf_dir), CYCLE).select("job_id", "season")


@query("latest_candidate", f"""
WITH {JOBS_SQL}
SELECT job_id, title, season, posted_at FROM jobs
WHERE active AND (season LIKE '%{CYCLE}%' OR season = 'Summer')
ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 1
""")
def latest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.latest_candidate(ad.jobs_of_orders(spark, sf_dir), CYCLE).select(
        "job_id", "title", "season", "posted_at"
    )


@query("dim_join", f"""
WITH {JOBS_SQL}, {COMPANIES_SQL}
SELECT job_id, title, name AS company_name FROM jobs JOIN companies USING (company_id)
""")
def dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = q.with_company(
        ad.jobs_of_orders(spark, sf_dir), ad.companies_of_customers(spark, sf_dir)
    )
    return joined.select("job_id", "title", "company_name")


@query("unscored_queue", f"""
WITH {JOBS_SQL}
SELECT job_id, title FROM jobs WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'R' AND l_linestatus = 'O')
""")
def unscored_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = ad.jobs_of_orders(spark, sf_dir).select("job_id", "title")
    return q.unscored(jobs, _scored_jobs(spark, sf_dir), "R", "O")


@query("never_scored", """
SELECT o_orderkey AS job_id FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def never_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs left when every score counts, whatever its versions."""
    scores = _scored_jobs(spark, sf_dir).select(
        "job_id", F.lit("p").alias("profile_version"), F.lit("r").alias("resume_version")
    )
    return q.unscored(ad.jobs_of_orders(spark, sf_dir).select("job_id"), scores, "p", "r")


@query("work_queue", f"WITH {_QUEUE_SQL} SELECT job_id, company_name, title, tier FROM queue")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("job_id", "company_name", "title", "tier")


@query("queue_limit", f"""
WITH {_QUEUE_SQL}
SELECT job_id, tier, posted_at FROM queue ORDER BY posted_at DESC, job_id LIMIT 100
""")
def queue_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir, limit=100).select("job_id", "tier", "posted_at")


@query("queue_preview", f"""
WITH {_QUEUE_SQL}
SELECT tier, company_name, title, job_id, (SELECT count(*) FROM queue) AS queue_size,
  greatest((SELECT count(*) FROM queue) - 20, 0) AS not_shown
FROM queue ORDER BY posted_at DESC, job_id LIMIT 20
""")
def queue_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.preview(_queue(spark, sf_dir)).select(
        "tier", "company_name", "title", "job_id", "queue_size", "not_shown"
    )


@query("queue_depth", f"WITH {_QUEUE_SQL} SELECT tier, count(*) AS n FROM queue GROUP BY tier")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.depth(_queue(spark, sf_dir))


# --- scoring -------------------------------------------------------------------------------------

_TEMPLATE = scoring.RequestTemplate(
    instructions="Rate this.", profile="likes: parts", resume="did: orders"
)
_LISTING_SQL = """'company: ' || name || chr(10) || 'title: ' || title || chr(10) ||
  'locations: ' || array_to_string(locations, ', ') || chr(10) ||
  'season: ' || coalesce(nullif(season, ''), 'unspecified') || chr(10) ||
  'sponsorship: ' || coalesce(nullif(sponsorship, ''), 'unspecified') || chr(10) ||
  'url: ' || url"""


@query("render_prompt", f"""
WITH {JOBS_SQL}, {COMPANIES_SQL}
SELECT job_id, 'Rate this.' || chr(10) || chr(10) || 'PROFILE' || chr(10) || 'likes: parts' ||
  chr(10) || chr(10) || 'RESUME' || chr(10) || 'did: orders' || chr(10) || chr(10) || 'LISTING' ||
  chr(10) || {_LISTING_SQL} AS request
FROM jobs JOIN companies USING (company_id)
""")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = q.with_company(
        ad.jobs_of_orders(spark, sf_dir), ad.companies_of_customers(spark, sf_dir)
    )
    listing = scoring.render_listing(
        F.col("company_name"), F.col("title"), F.col("locations"), F.col("season"),
        F.col("sponsorship"), F.col("url"),
    )
    return joined.select("job_id", scoring.render_request(_TEMPLATE, listing).alias("request"))


def _length_scorer_factory() -> scoring.ScorerFactory:
    """Deterministic stand-in for the external model: scores follow from the request's length."""

    def factory() -> scoring.Scorer:
        def answer(request: str) -> str:
            size = len(request)
            if size % 29 == 0:
                raise ValueError("refused")
            if size % 31 == 0:
                return "no idea"
            return (
                f'{{"qualification_score": {size % 101}, "fit_score": {size % 89}, '
                f'"class_year_eligible": {"true" if size % 2 else "false"}, '
                f'"top_matches": ["size {size}"], "top_gaps": []}}'
            )

        return answer

    return factory


_REQUEST_SIZE = f"{len(_TEMPLATE.header())} + length({_LISTING_SQL})"
_CALLED_SQL = f"""{JOBS_SQL}, {COMPANIES_SQL},
called AS (
  SELECT j.job_id, {ORDER_TIER_SQL} AS tier, {_REQUEST_SIZE} AS size
  FROM jobs j JOIN companies USING (company_id)
  WHERE {_IS_CANDIDATE}
    AND {ORDER_TIER_SQL} IN ('named_target', 'keyword')
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = j.job_id
      AND l.l_returnflag = 'A' AND l.l_linestatus = 'F')
)"""


@query("scorer_calls", f"""
WITH {_CALLED_SQL}
SELECT job_id, tier,
  CASE WHEN size % 29 = 0 THEN 'ValueError: refused'
    WHEN size % 31 = 0 THEN 'not one JSON object' END AS error,
  CASE WHEN size % 29 <> 0 AND size % 31 <> 0 THEN CAST(size % 101 AS INTEGER) END
    AS qualification_score,
  CASE WHEN size % 29 <> 0 AND size % 31 <> 0 THEN CAST(size % 89 AS INTEGER) END AS fit_score
FROM called
""")
def scorer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue, request, scorer call and parsed answer for every queued job."""
    answers = scoring.call_scorer(_queue(spark, sf_dir), _length_scorer_factory(), _TEMPLATE)
    return scoring.parse_response(answers).select(
        "job_id", "tier", "error", "qualification_score", "fit_score"
    ).withColumn("job_id", F.col("job_id").cast("bigint"))


@query("strip_fences", f"""
SELECT doc_id, CASE doc_id % 5
  WHEN 4 THEN {sql_strip("text[1:length(text)]")}
  ELSE {sql_strip("text")} END AS answer
FROM documents
""")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    # The check holds for texts without a fence of their own, so fences in a text are marked.
    body = F.replace(text, F.lit(scoring.FENCE), F.lit("'''"))
    response = (
        F.when(d % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(d % 5 == 1, F.concat(F.lit(" \n```\n"), body, F.lit("\n```\nthat is all")))
        .when(d % 5 == 2, F.concat(F.lit("```"), body))
        .when(d % 5 == 3, F.concat(F.lit("\n\t"), body, F.lit(" ")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", scoring.strip_fences(response).alias("answer")
    )


# Answers made from events: what the event's number decides, and what parsing should make of it.
_OK = "event_id % 10 IN (0, 1, 2, 8, 9)"
_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    rest = F.lit(', "class_year_eligible": 1, "top_matches": ["a", "b"], "top_gaps": null')
    fields = F.concat(F.lit('"qualification_score": '), k, F.lit(', "fit_score": '),
                      (e % 101).cast("string"))
    full = F.concat(F.lit("{"), fields, rest, F.lit(', "summary": "'), F.col("event_type"),
                    F.lit('"}'))
    response = (
        F.when(e % 10 == 0, full)
        .when(e % 10 == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(e % 10 == 2, F.concat(F.lit("```\n"), full, F.lit("\n``` done")))
        .when(e % 10 == 3, F.concat(F.lit("{"), fields, F.lit("}")))
        .when(e % 10 == 4, F.concat(F.lit('{"qualification_score": 7.5, "fit_score": 1'), rest,
                                    F.lit("}")))
        .when(e % 10 == 5, F.concat(F.lit('{"qualification_score": "42", "fit_score": 1'), rest,
                                    F.lit("}")))
        .when(e % 10 == 6, F.concat(F.lit("["), full, F.lit("]")))
        .when(e % 10 == 7, F.concat(full, F.lit(" I hope this helps")))
        .when(e % 10 == 8, F.concat(F.lit("  "), full, F.lit("\n")))
        .otherwise(F.replace(full, F.lit('eligible": 1,'), F.lit('eligible": "",')))
    )
    return table(spark, sf_dir, "events").repartition("event_id").select(
        F.col("event_id").alias("job_id"), F.lit("keyword").alias("tier"),
        response.alias("response"), F.lit(None).cast("string").alias("error"),
    )


@query("parse_response", f"""
SELECT event_id AS job_id, {_K} AS qualification_score,
  CAST(event_id % 101 AS INTEGER) AS fit_score,
  event_id % 10 <> 9 AS class_year_eligible, 'a|b' AS top_matches,
  0 AS n_gaps, event_type AS summary
FROM events WHERE {_OK}
""")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = scoring.parsed_ok(scoring.parse_response(_answers(spark, sf_dir)))
    return good.select(
        "job_id", "qualification_score", "fit_score", "class_year_eligible",
        F.array_join("top_matches", "|").alias("top_matches"),
        F.size("top_gaps").alias("n_gaps"), "summary",
    )


@query("parse_failures", """
SELECT event_id AS job_id, CASE event_id % 10 WHEN 3 THEN 'missing field'
  WHEN 4 THEN 'score not an integer from 0 to 100'
  WHEN 5 THEN 'score not an integer from 0 to 100' ELSE 'not one JSON object' END AS error
FROM events WHERE event_id % 10 BETWEEN 3 AND 7
""")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = scoring.parsed_failed(scoring.parse_response(_answers(spark, sf_dir)))
    return bad.select("job_id", "error")


@query("parse_ok_failed", f"""
SELECT count(*) FILTER ({_OK}) AS scored, count(*) FILTER (NOT ({_OK})) AS failed FROM events
""")
def parse_ok_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcome_counts(scoring.parse_response(_answers(spark, sf_dir)))


@query("score_insert_ignore", """
WITH batch AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey) AS place
  FROM lineitem WHERE l_returnflag <> 'A' AND l_tax <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS score FROM batch b
WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'A'
  AND s.l_orderkey = b.l_orderkey AND s.l_linenumber = b.l_linenumber)
""")
def score_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = ("l_orderkey", "l_linenumber")
    stored = lines.filter("l_returnflag = 'A'").select(*key)
    batch = lines.filter("l_returnflag <> 'A'").select(
        *key, "l_partkey", "l_suppkey",
        F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("score"),
    )
    return scoring.insert_or_ignore(
        stored, batch, key, F.struct("l_partkey", "l_suppkey"), required=("score",)
    )


# --- audits --------------------------------------------------------------------------------------


@query("score_band", f"""
WITH {SCORES_SQL}
SELECT CASE WHEN q_score >= 85 THEN '85-100' WHEN q_score >= 65 THEN '65-84'
    WHEN q_score >= 45 THEN '45-64' WHEN q_score >= 25 THEN '25-44' WHEN q_score >= 5 THEN '5-24'
    ELSE '0-4' END AS band, count(*) AS n, min(q_score) AS lowest, max(q_score) AS highest
FROM scores GROUP BY 1
""")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("qualification_score")
    rows = ad.scores_of_lineitem(spark, sf_dir).select(audits.score_band(score).alias("band"), score)
    return rows.groupBy("band").agg(
        F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest")
    )


# Line status and return flag as role families, with the ranges of the default rules.
_FAMILIES = (
    ("quant_research", "profile_version = 'A' AND summary = 'F'", 5, 20),
    ("software_engineer", "profile_version = 'A' AND summary = 'O'", 15, 35),
    ("forward_deployed_or_strategy", "profile_version = 'R'", 60, 85),
    ("hardware", "profile_version = 'X'", 5, 15),
)


@query("range_audit", f"WITH {SCORES_SQL}" + " UNION ALL ".join(f"""
SELECT '{family}' AS family, {low} AS low, {high} AS high, count(*) AS covered,
  count(*) FILTER (q_score NOT BETWEEN {low} AND {high}) AS outside,
  count(*) FILTER (q_score > {high}) AS above,
  CASE WHEN count(*) > 0 THEN
    round(count(*) FILTER (q_score NOT BETWEEN {low} AND {high}) / count(*), 6) END AS outside_share
FROM scores WHERE {condition}""" for family, condition, low, high in _FAMILIES))
def range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules: list[tuple[str, Column, int, int]] = [
        (family, F.expr(condition), low, high) for family, condition, low, high in _FAMILIES
    ]
    return audits.range_audit(
        ad.scores_of_lineitem(spark, sf_dir), F.col("qualification_score"), rules
    )


@query("axis_split_stats", f"""
WITH {SCORES_SQL}
SELECT count(*) AS n, round(avg(q_score), 6) AS mean_q, round(avg(fit_score), 6) AS mean_fit,
  round(stddev_samp(q_score), 6) AS sd_q, round(stddev_samp(fit_score), 6) AS sd_fit,
  round(corr(q_score, fit_score), 6) AS correlation,
  count(*) FILTER (q_score <= 25 AND fit_score >= 75) AS wanted_not_qualified,
  count(*) FILTER (q_score >= 75 AND fit_score <= 25) AS qualified_not_wanted
FROM scores
""")
def axis_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.axis_split(ad.scores_of_lineitem(spark, sf_dir))


@query("cluster_share", f"""
WITH {SCORES_SQL}
SELECT count(*) AS n, count(*) FILTER (q_score BETWEEN 70 AND 75) AS clustered,
  round(count(*) FILTER (q_score BETWEEN 70 AND 75) / count(*), 6) AS share
FROM scores
""")
def cluster_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.cluster_share(ad.scores_of_lineitem(spark, sf_dir))
