"""Streams and whole runs against a store, on the driver's tables.

Each query keeps its store and its stream checkpoint in a new scratch folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.catalog import adapters as ad
from listwright.catalog.adapters import FEED_SQL, PART_TIER_SQL, PARTS_SQL, PART_RULES
from listwright.catalog.ingest import PULLED_JOBS_SQL
from listwright.catalog.registry import epoch_us, query, table
from listwright.functions import text as tx
from listwright.functions.rules import TierRules
from listwright.operators import merge, scoring
from listwright.plans import pull as pl, report, score as sc
from listwright.sources.config import ConfigDocument
from listwright.sources.scratch import scratch_dir
from listwright.sources.store import Merged, Store
from listwright.streaming.stateless import stream_dedup, stream_tiers
from listwright.streaming.upsert import stream_fold

RUN_AT = datetime(2024, 1, 1)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream."""
    schema = table(spark, sf_dir, name).schema
    # As a pattern, because a stream takes a single file by pattern only.
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def _finish(stream: StreamingQuery) -> None:
    stream.awaitTermination()


def _written(spark: SparkSession, rows: DataFrame, scratch: str) -> DataFrame:
    """Run a stream into files to its end and read them."""
    _finish(
        rows.writeStream.format("parquet").option("path", f"{scratch}/rows")
        .option("checkpointLocation", f"{scratch}/checkpoint")
        .trigger(availableNow=True).start()
    )
    return spark.read.schema(rows.schema).parquet(f"{scratch}/rows")


STREAMED = merge.MergeSpec(
    keys=("sighting_id", "event_type", "user_id"),
    frozen=("first_value",),
    mutable=("value", "props", "seen_at"),
)


@query("stream_upsert", """
SELECT event_type, user_id, arg_min(value, event_id) AS first_value,
  arg_max(value, event_id) AS value, arg_max(props, event_id) AS props,
  arg_max(epoch_us(ts), event_id) AS seen_at, min(event_id) AS first_seq,
  max(event_id) AS last_seq
FROM events GROUP BY event_type, user_id
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings arriving as a stream, folded into a stored table."""
    events = _stream(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id",
        tx.natural_id(F.col("event_type"), F.col("user_id").cast("string")).alias("sighting_id"),
        F.col("value").alias("first_value"), "value", "props", epoch_us("ts").alias("seen_at"),
    )
    sightings = merge.sightings(events, STREAMED, F.col("event_id"))
    scratch = scratch_dir(spark, "stream-upsert")
    store = Store(
        spark, f"{scratch}/store", {"sightings": sightings.schema},
        {"sightings": Merged(
            "sighting_id", lambda rows, columns=None: merge.fold(rows, STREAMED.only(columns))
        )},
    )
    _finish(stream_fold(store, sightings, "sightings", "events", f"{scratch}/checkpoint"))
    return store.read("sightings").drop("sighting_id")


@query("stream_tiers", f"""
WITH {PARTS_SQL}, tiered AS (SELECT p_partkey, {PART_TIER_SQL} AS tier FROM parts)
SELECT * FROM tiered WHERE tier <> 'skip'
""")
def stream_tier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings arriving as a stream, tiered and filtered."""
    parts = _stream(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_type", F.lit(" "), "p_brand").alias("company_name"),
        F.col("p_name").alias("title"),
    )
    tiered = stream_tiers(parts, "all", PART_RULES).select("p_partkey", "tier")
    return _written(spark, tiered, scratch_dir(spark, "stream-tiers"))


@query("stream_dedup", """
SELECT DISTINCT sha256(lang || '::' || trim(lower(text)) || '::')[:16] AS fingerprint
FROM documents
""")
def stream_dedup_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per content of the texts arriving as a stream."""
    no_places = F.array().cast("array<string>")
    listed = _stream(spark, sf_dir, "documents").select(
        tx.fingerprint(F.col("lang"), F.col("text"), no_places).alias("fingerprint"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("posted"),
    )
    once = stream_dedup(listed, "36500 days", F.col("posted")).select("fingerprint")
    return _written(spark, once, scratch_dir(spark, "stream-dedup"))


def _pulled(spark: SparkSession, sf_dir: str) -> Store:
    """A store after one pull of the documents seen as feeds."""
    store = Store(spark, scratch_dir(spark, "store"))
    base = store.initialize()
    part = pl.stage(store, ad.feed_payloads(spark, sf_dir), base.version + 1)
    pl.merge_staged(store, [part], base, RUN_AT)
    return store


@query("store_pull", PULLED_JOBS_SQL)
def store_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored jobs with their company after a pull."""
    store = _pulled(spark, sf_dir)
    companies = store.read("companies", columns=("company_id", "name_normalized"))
    return store.read("jobs").join(companies, "company_id").select(
        "source", "source_id", "fingerprint", F.col("name_normalized").alias("company"), "title",
        "url", "ats_provider", "ats_token", "season", "active", "posted_at",
        F.array_join("locations", "|").alias("locations"),
        F.col("first_seq.pos").alias("first_pos"), F.col("last_seq.pos").alias("last_pos"),
    )


# Companies are named after the documents' sources.
SOURCE_RULES = TierRules(
    named=("src1", "src7"), keywords=(r"\bsrc1\d\b",), skips=(r"\A(?!)",)
)
PROFILE, RESUME = ConfigDocument.of(b"likes: everything"), ConfigDocument.of(b"did: something")


def _url_scorer_factory() -> scoring.ScorerFactory:
    """Deterministic stand-in for the external model: scores follow from the listing's URL."""

    def factory() -> scoring.Scorer:
        def answer(request: str) -> str:
            size = len(request.rsplit("url: ", 1)[1])
            if size % 7 == 0:
                raise ValueError("refused")
            return (
                f'```json\n{{"qualification_score": {size}, "fit_score": {100 - size}, '
                '"class_year_eligible": true, "top_matches": ["url"], "top_gaps": [], '
                f'"summary": "size {size}"}}\n```'
            )

        return answer

    return factory


@query("scoring_run", f"""
WITH {FEED_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY seq) AS up,
    row_number() OVER (PARTITION BY source, source_id ORDER BY seq DESC) AS down
  FROM listing),
companies AS (
  SELECT name_normalized, company_name AS company FROM listing
  QUALIFY row_number() OVER (PARTITION BY name_normalized ORDER BY seq) = 1),
providers AS (
  SELECT name_normalized, ats_provider FROM listing
  QUALIFY row_number() OVER (
    PARTITION BY name_normalized ORDER BY ats_provider IS NULL, seq) = 1),
jobs AS (
  SELECT l.source, l.source_id, c.company, l.url, p.ats_provider, l.active, l.season,
    CASE WHEN regexp_matches(c.company, '(?i)\\b(src1|src7)\\b') THEN 'named_target'
      WHEN regexp_matches(c.company || ' ' || l.title, '(?i)\\bsrc1\\d\\b') THEN 'keyword'
      ELSE 'skip' END AS tier, length(l.url) AS size
  FROM ranked l
  JOIN ranked f ON f.source = l.source AND f.source_id = l.source_id AND f.up = 1
  JOIN companies c ON c.name_normalized = f.name_normalized
  JOIN providers p ON p.name_normalized = f.name_normalized
  WHERE l.down = 1)
SELECT source, source_id, company, url, coalesce(nullif(ats_provider, ''), 'unknown') AS ats,
  CAST(size AS INTEGER) AS q_score, CAST(100 - size AS INTEGER) AS fit_score,
  CAST(100 AS INTEGER) AS combined, 'size ' || size AS summary, tier
FROM jobs
WHERE active AND (season LIKE '%2027%' OR season IN ('Summer', 'N/A')) AND tier <> 'skip'
  AND size % 7 <> 0
""")
def scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull, queue, score and store, then the review frame of what was stored."""
    store = _pulled(spark, sf_dir)
    run = sc.ScoreRun(PROFILE, RESUME, "stand-in", "all", SOURCE_RULES, chunks=2)
    sc.score(store, run, _url_scorer_factory(), RUN_AT)
    jobs = store.read("jobs", columns=("job_id", "source", "source_id"))
    return report.review_frame(store).join(jobs, "job_id").select(
        "source", "source_id", "company", "url", "ats", "q_score", "fit_score", "combined",
        "summary", "tier",
    )
