"""Review queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.catalog import adapters as ad
from listwright.catalog.adapters import COMPANIES_SQL, JOBS_SQL, REVIEW_SQL, SCORES_SQL
from listwright.catalog.registry import query, table
from listwright.operators import review

_TOTAL_ORDER = "combined DESC, job_id, profile_version, resume_version"
_TOP_COLUMNS = "company, title, locations, q_score, fit_score, summary, url, resume_version"
_TOP = _TOP_COLUMNS.split(", ")


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        ad.scores_of_lineitem(spark, sf_dir), ad.jobs_of_orders(spark, sf_dir),
        ad.companies_of_customers(spark, sf_dir),
    )


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.score_view(*_star(spark, sf_dir))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_columns(view(spark, sf_dir))


@query("score_star_join", f"""
WITH {JOBS_SQL}, {COMPANIES_SQL}, {SCORES_SQL}
SELECT name AS company, title, array_to_string(locations, '|') AS locations, url, ats_provider,
  q_score, fit_score, summary, tier, created_at
FROM scores JOIN jobs USING (job_id) JOIN companies USING (company_id)
""")
def score_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select(
        "company", "title", F.array_join("locations", "|").alias("locations"), "url",
        "ats_provider", "q_score", "fit_score", "summary", "tier", "created_at",
    )


@query("review_columns", f"WITH {REVIEW_SQL} SELECT * FROM review")
def review_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir)


@query("top_targets", f"""
WITH {REVIEW_SQL}
SELECT {_TOP_COLUMNS} FROM review WHERE q_score >= 40 ORDER BY {_TOTAL_ORDER} LIMIT 30
""")
def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _star(spark, sf_dir)
    return review.described(review.top_targets(review.rankable(*star)), *star).select(*_TOP)


@query("best_per_group", f"""
WITH {REVIEW_SQL}
SELECT {_TOP_COLUMNS}, combined FROM review WHERE tier = 'named_target'
QUALIFY row_number() OVER (PARTITION BY company ORDER BY {_TOTAL_ORDER}) = 1
""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.best_listings(*_star(spark, sf_dir)).select(*_TOP, "combined")


@query("kpi_counts", f"""
WITH {JOBS_SQL}, {SCORES_SQL}
SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM scores) AS total_scored,
  (SELECT count(*) FROM jobs WHERE active) AS total_active,
  (SELECT max(created_at) FROM scores) AS last_refreshed
""")
def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.kpis(ad.jobs_of_orders(spark, sf_dir), ad.scores_of_lineitem(spark, sf_dir))


_BUCKETS_SQL = """
axes AS (SELECT 'q_score' AS axis, q_score AS score FROM scores
  UNION ALL SELECT 'fit_score', fit_score FROM scores),
dense AS (SELECT CAST(unnest(range(0, 100, 10)) AS INTEGER) AS bucket),
cells AS (SELECT axis, bucket FROM dense, (SELECT DISTINCT axis FROM axes))"""


@query("dense_histogram", f"""
WITH {SCORES_SQL}, {_BUCKETS_SQL}
SELECT c.axis, c.bucket, count(a.score) AS n, c.bucket || '–' || (c.bucket + 9) AS label
FROM cells c LEFT JOIN axes a
  ON a.axis = c.axis AND CAST(floor(a.score / 10) * 10 AS INTEGER) = c.bucket
GROUP BY c.axis, c.bucket
""")
def dense_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ad.scores_of_lineitem(spark, sf_dir)
    return review.dense_histogram(
        scores.withColumnRenamed("qualification_score", "q_score")
    )


@query("histogram_closed_top", f"""
WITH {SCORES_SQL}, {_BUCKETS_SQL}
SELECT c.axis, c.bucket, count(a.score) AS n, c.bucket || '–' || (c.bucket + 9) AS label
FROM cells c LEFT JOIN axes a
  ON a.axis = c.axis AND least(CAST(floor(a.score / 10) * 10 AS INTEGER), 90) = c.bucket
GROUP BY c.axis, c.bucket
""")
def histogram_closed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ad.scores_of_lineitem(spark, sf_dir)
    return review.dense_histogram(
        scores.withColumnRenamed("qualification_score", "q_score"), closed_top=True
    )


@query("provider_counts", f"""
WITH {REVIEW_SQL},
once AS (SELECT DISTINCT ON (company, title) ats FROM review
  ORDER BY company, title, job_id, profile_version, resume_version)
SELECT ats, count(*) AS jobs FROM once GROUP BY ats
""")
def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.provider_counts(review.scored_listings(*_star(spark, sf_dir)), ("job_id",))


@query("top20_combined", f"""
WITH {REVIEW_SQL}
SELECT company, title, q_score, fit_score, resume_version FROM review
ORDER BY {_TOTAL_ORDER} LIMIT 20
""")
def top20_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _star(spark, sf_dir)
    return review.described(review.top_combined(review.rankable(*star)), *star).select(
        "company", "title", "q_score", "fit_score", "resume_version"
    )


@query("winners_latest_version", f"""
WITH {REVIEW_SQL}
SELECT company, title, profile_version, q_score, fit_score, resume_version FROM review
WHERE profile_version = (SELECT profile_version FROM scores
    ORDER BY created_at DESC, job_id DESC, resume_version DESC LIMIT 1)
  AND q_score >= 50 AND fit_score >= 40
ORDER BY {_TOTAL_ORDER} LIMIT 50
""")
def winners_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _star(spark, sf_dir)
    latest = review.latest_version(star[0], F.struct("created_at", "job_id", "resume_version"))
    return review.described(review.winners(review.rankable(*star), latest), *star).select(
        "company", "title", "profile_version", "q_score", "fit_score", "resume_version"
    )


_PHRASES = ("red widget", "Widget", "hot", "e b", "gizmo", "none of these", "plate")


@query("phrase_coverage", " UNION ALL ".join(
    f"SELECT '{phrase}' AS phrase, count(*) AS n FROM part WHERE p_name ILIKE '%{phrase}%'"
    for phrase in _PHRASES
))
def phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.phrase_coverage(table(spark, sf_dir, "part"), "p_name", _PHRASES)


@query("report_format", f"""
WITH {REVIEW_SQL}
SELECT job_id, resume_version, rpad(company[1:24], 25, ' ') || ' ' || rpad(title[1:44], 45, ' ')
  || ' ' || lpad(CAST(q_score AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(fit_score AS VARCHAR), 3, ' ')
  AS line
FROM review ORDER BY {_TOTAL_ORDER} LIMIT 20
""")
def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = review.report_line(
        F.col("company"), F.col("title"), F.col("q_score"), F.col("fit_score")
    )
    star = _star(spark, sf_dir)
    return review.described(review.top_combined(review.rankable(*star)), *star).select(
        "job_id", "resume_version", line.alias("line")
    )
