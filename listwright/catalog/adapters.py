"""The driver's tables seen as feeds, listings, companies and scores.

Each adapter has its SQL twin next to it, written from the table's columns without going through the
library, so that a check compares two separate derivations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright.catalog.registry import epoch_s, epoch_us, table
from listwright.functions.rules import TierRules
from listwright.operators.normalize import enrich, normalize

# --- documents as JSON feeds ---------------------------------------------------------------------

# JSON text of a flag that is absent, null, or has one of several values, by document number.
VISIBLE_JSON = ("", "null", "false", "true", "0", "1", '""', '"yes"', "[]", "")
ACTIVE_JSON = ("", "null", "false", "true")
SEASON_JSON = (
    '"season":"Summer"',
    '"season":"","terms":["Summer 2027","Fall 2027"]',
    '"terms":["","Fall 2027"]',
    '"terms":[]',
    '"season":null',
    '"season":"N/A","terms":["Summer 2027"]',
    '"season":"Fall 2026"',
    '"season":"Spring 2027"',
)
COMPANY_SUFFIX = (", Inc.", " LLC", "", " Corporation, Inc.", ", Ltd.", " Corp.", " Inc, LLC")


def _pick(options: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), (number % len(options)).cast("int"))


def _flag(name: str, options: tuple[str, ...], number: Column) -> Column:
    value = _pick(options, number)
    return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(f',"{name}":'), value))


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one raw feed object: languages are the feeds, doc_id the position."""
    # Parsing costs far more than moving the text, and one file may be one task.
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars"
    ).repartition("doc_id")
    d = F.col("doc_id")
    source = F.col("source")
    company = F.when(d % 17 == 0, F.lit("")).otherwise(
        F.concat(F.lit("\t "), F.upper(source), _pick(COMPANY_SUFFIX, d), F.lit("  "))
    )
    title = F.when(d % 19 == 3, F.lit("   ")).otherwise(F.col("text"))
    number = d.cast("string")
    url = (
        F.when(d % 6 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), source,
                                    F.lit("/jobs/"), number))
        .when(d % 6 == 1, F.concat(F.lit("https://user@JOBS.lever.co:443/"), F.upper(source),
                                   F.lit("/9?x=1#f")))
        .when(d % 6 == 2, F.concat(F.lit("https://careers-"), source, F.lit(".icims.com/jobs")))
        .when(d % 6 == 3, F.concat(F.lit("https://"), F.upper(source),
                                   F.lit(".wd5.myworkdayjobs.com/x")))
        .when(d % 6 == 4, F.concat(F.lit("https://sjobs.brassring.com/"), number))
        .otherwise(F.concat(F.lit("https://www.example.com/jobs/"), number))
    )
    places = (
        F.when(d % 4 == 0, F.lit(""))
        .when(d % 4 == 1, F.lit(',"locations":null'))
        .when(d % 4 == 2, F.lit(',"locations":[]'))
        .otherwise(F.concat(F.lit(',"locations":["'), F.col("lang"), F.lit('"," NYC ","remote"]')))
    )
    identity = (
        F.when(d % 23 == 5, F.lit('"id":""'))
        .when(d % 3 == 1, F.concat(F.lit('"id":'), (F.floor(d / 4) + 1).cast("string")))
        .otherwise(F.concat(F.lit('"id":"'), (F.floor(d / 4) + 1).cast("string"), F.lit('"')))
    )
    company_url = (
        F.when(d % 3 == 0, F.lit(',"company_url":""'))
        .when(d % 3 == 1, F.lit(""))
        .otherwise(F.concat(F.lit(',"company_url":"https://'), source, F.lit('.example.com"')))
    )
    texts = F.to_json(F.struct(company.alias("company_name"), title.alias("title"),
                               url.alias("url"), F.col("lang").alias("category")))
    payload = F.concat(
        F.left(texts, F.length(texts) - 1), F.lit(","), identity,
        _flag("is_visible", VISIBLE_JSON, d), _flag("active", ACTIVE_JSON, F.floor(d / 10)),
        F.lit(","), _pick(SEASON_JSON, d), places, company_url,
        F.lit(',"date_posted":'), (F.lit(1700000000) + d * 60).cast("string"),
        F.lit(',"extra":{"size":'), F.col("n_chars").cast("string"), F.lit("}}"),
    )
    feed = (
        F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1)
        .when(F.col("lang") == "es", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    )
    return docs.select(
        F.col("lang").alias("source"), feed.alias("source_ord"), F.lit("").alias("file"),
        d.alias("pos"), F.lit("ok").alias("feed_status"), payload.alias("payload"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(feed_payloads(spark, sf_dir), 1)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).filter(F.col("verdict") == "kept")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(kept(spark, sf_dir))


_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '" + "".join(
    f"||chr({c})" for c in (133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {_BLANKS})"


# Columns of every document seen as a feed object, with the three skip conditions.
FEED_SQL = f"""
feed AS (
  SELECT doc_id AS pos, lang AS source,
    CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END
      AS source_ord,
    CAST(doc_id // 4 + 1 AS VARCHAR) AS source_id,
    {sql_strip("upper(source) || CASE doc_id % 7 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN '' WHEN 3 THEN ' Corporation, Inc.' WHEN 4 THEN ', Ltd.' WHEN 5 THEN ' Corp.' ELSE ' Inc, LLC' END")}
      AS company_name,
    lower(source) || CASE doc_id % 7 WHEN 6 THEN ' inc' ELSE '' END AS name_normalized,
    CASE WHEN doc_id % 19 = 3 THEN '' ELSE {sql_strip("text")} END AS title,
    CASE doc_id % 6
      WHEN 0 THEN 'https://boards.greenhouse.io/' || source || '/jobs/' || doc_id
      WHEN 1 THEN 'https://user@JOBS.lever.co:443/' || upper(source) || '/9?x=1#f'
      WHEN 2 THEN 'https://careers-' || source || '.icims.com/jobs'
      WHEN 3 THEN 'https://' || upper(source) || '.wd5.myworkdayjobs.com/x'
      WHEN 4 THEN 'https://sjobs.brassring.com/' || doc_id
      ELSE 'https://www.example.com/jobs/' || doc_id END AS url,
    CASE doc_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'icims'
      WHEN 3 THEN 'workday' WHEN 4 THEN 'brassring' END AS ats_provider,
    CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN upper(source) WHEN 2 THEN lower(source)
      WHEN 3 THEN lower(source) END AS ats_token,
    CASE WHEN doc_id % 4 = 3 THEN [lang, ' NYC ', 'remote'] ELSE CAST([] AS VARCHAR[]) END
      AS locations,
    CASE doc_id % 8 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Summer 2027' WHEN 2 THEN ''
      WHEN 5 THEN 'N/A' WHEN 6 THEN 'Fall 2026' WHEN 7 THEN 'Spring 2027' END AS season,
    (doc_id // 10) % 4 IN (0, 3) AS active,
    CASE WHEN doc_id % 3 = 2 THEN 'https://' || source || '.example.com' END AS company_url,
    1700000000 + doc_id * 60 AS posted_at,
    lang AS category, n_chars,
    doc_id % 10 IN (0, 3, 5, 7, 9) AS visible,
    doc_id % 23 <> 5 AND doc_id % 17 <> 0 AS complete
  FROM documents
),
listing AS (
  SELECT *, source_ord * 1000000000000 + pos AS seq FROM feed WHERE visible AND complete
)"""

# --- orders and customers as jobs and companies --------------------------------------------------

CYCLE = "1997"


def jobs_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    year = F.year("o_orderdate").cast("string")
    season = (
        F.when(priority.startswith("1"), F.lit(None).cast("string"))
        .when(priority.startswith("2"), F.lit("N/A"))
        .when(priority.startswith("3"), F.lit("Summer"))
        .when(priority.startswith("4"), F.concat(F.lit("Fall "), year))
        .otherwise(F.concat(F.lit("Summer "), year))
    )
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("company_id"),
        F.concat(priority, F.lit(" order "), status).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(priority, status)).alias("locations"),
        F.concat(F.lit("https://boards.greenhouse.io/o/"), F.col("o_orderkey").cast("string"))
        .alias("url"),
        season.alias("season"),
        F.when(status == "P", F.lit("")).otherwise(priority).alias("sponsorship"),
        (status != "F").alias("active"),
        epoch_s("o_orderdate").alias("posted_at"),
    )


JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS company_id,
    o_orderpriority || ' order ' || o_orderstatus AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST([] AS VARCHAR[])
      ELSE [o_orderpriority, o_orderstatus] END AS locations,
    'https://boards.greenhouse.io/o/' || o_orderkey AS url,
    CASE o_orderpriority[1] WHEN '1' THEN NULL WHEN '2' THEN 'N/A' WHEN '3' THEN 'Summer'
      WHEN '4' THEN 'Fall ' || year(o_orderdate) ELSE 'Summer ' || year(o_orderdate) END AS season,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS sponsorship,
    o_orderstatus <> 'F' AS active,
    epoch_us(o_orderdate) // 1000000 AS posted_at
  FROM orders
)"""


def companies_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.concat(F.initcap(segment), F.lit(" "), F.col("c_name")).alias("name"),
        F.when(segment == "BUILDING", F.lit(None).cast("string"))
        .when(segment == "MACHINERY", F.lit(""))
        .otherwise(F.lower(segment)).alias("ats_provider"),
    )


COMPANIES_SQL = """
companies AS (
  SELECT c_custkey AS company_id,
    c_mktsegment[1] || lower(c_mktsegment[2:]) || ' ' || c_name AS name,
    CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN ''
      ELSE lower(c_mktsegment) END AS ats_provider
  FROM customer
)"""

# Rules for these companies and titles.
ORDER_RULES = TierRules(
    named=("household", "customer#000000007"),
    keywords=(r"\bfurniture\b", r"\b1.urgent\b", r"\border p\b"),
    skips=(r"\b5-low\b", r"\bnot specified\b"),
)

ORDER_TIER_SQL = r"""
CASE WHEN regexp_matches(name, '(?i)\b(household|customer#000000007)\b') THEN 'named_target'
  WHEN regexp_matches(title, '(?i)\b5-low\b|\bnot specified\b') THEN 'skip'
  WHEN regexp_matches(name || ' ' || title, '(?i)\bfurniture\b|\b1.urgent\b|\border p\b')
    THEN 'keyword'
  ELSE 'skip' END"""

# --- line items as scores ------------------------------------------------------------------------


def scores_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per line item; the resume version carries the rest of the line's key."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        flag.alias("profile_version"),
        F.concat_ws("-", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("resume_version"),
        (F.col("l_quantity") * 2).cast("int").alias("qualification_score"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("fit_score"),
        F.when(flag == "N", F.lit(None).cast("string")).otherwise(F.col("l_linestatus"))
        .alias("summary"),
        F.when(flag == "R", "named_target").when(flag == "A", "keyword").otherwise("skip")
        .alias("tier"),
        epoch_us("l_shipdate").alias("created_at"),
    )


SCORES_SQL = """
scores AS (
  SELECT l_orderkey AS job_id, l_returnflag AS profile_version,
    l_linestatus || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS resume_version,
    CAST(l_quantity * 2 AS INTEGER) AS q_score,
    CAST(round(l_discount * 1000) AS INTEGER) AS fit_score,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus END AS summary,
    CASE l_returnflag WHEN 'R' THEN 'named_target' WHEN 'A' THEN 'keyword' ELSE 'skip' END AS tier,
    epoch_us(l_shipdate) AS created_at
  FROM lineitem
)"""

REVIEW_SQL = f"""{JOBS_SQL}, {COMPANIES_SQL}, {SCORES_SQL},
review AS (
  SELECT job_id, profile_version, resume_version, name AS company, title,
    CASE WHEN len(locations) = 0 THEN '—' ELSE array_to_string(locations, ', ') END AS locations,
    url, coalesce(nullif(ats_provider, ''), 'unknown') AS ats, q_score, fit_score,
    q_score + fit_score AS combined, coalesce(summary, '') AS summary, tier, created_at
  FROM scores JOIN jobs USING (job_id) JOIN companies USING (company_id)
)"""

# --- parts as listings to tier -------------------------------------------------------------------

PART_RULES = TierRules(
    named=("brand#17", "brand#3", "promo brand#2"),
    keywords=(r"\bwidget\b", r"\bred.gizmo\b", r"\bhot (?:rod|gear)\b", r"\bstandard\b"),
    skips=(r"\bbolt\b", r"\bring\b", r"\bsmall\b"),
)
PART_NAMED = r"(?i)\b(brand#17|brand#3|promo brand#2)\b"
PART_KEYWORD = r"(?i)\bwidget\b|\bred.gizmo\b|\bhot (rod|gear)\b|\bstandard\b"
PART_SKIP = r"(?i)\bbolt\b|\bring\b|\bsmall\b"


def parts_as_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat("p_type", F.lit(" "), "p_brand").alias("company_name"),
        F.col("p_name").alias("title"),
    )


PARTS_SQL = """
parts AS (
  SELECT p_partkey, p_type || ' ' || p_brand AS company_name, p_name AS title FROM part
)"""
PART_TIER_SQL = f"""
CASE WHEN regexp_matches(company_name, '{PART_NAMED}') THEN 'named_target'
  WHEN regexp_matches(title, '{PART_SKIP}') THEN 'skip'
  WHEN regexp_matches(company_name || ' ' || title, '{PART_KEYWORD}') THEN 'keyword'
  ELSE 'skip' END"""
