"""Forms of earlier queries for tables, rule sets and streams that do not fit the simple ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.catalog import adapters as ad
from listwright.catalog.adapters import COMPANIES_SQL, JOBS_SQL, PARTS_SQL, SCORES_SQL
from listwright.catalog.registry import epoch_us, query, table
from listwright.fixed_values import ROLE_RANGES
from listwright.functions import text as tx
from listwright.operators import merge, queue, review
from listwright.operators.heavy import most_common_bounded
from listwright.operators.ranges import range_rule_audit
from listwright.operators.rule_join import KEYWORD, NAMED, SKIP, tier_by_table
from listwright.sources.bucketed import buckets_for, write_bucketed
from listwright.sources.scratch import scratch_dir
from listwright.streaming.sliced import first_slice_of, fold_stream, folded_state, land_in_slices, read_slices
from listwright.streaming.stateless import stream_dedup

# --- values, rules and ranges ----------------------------------------------------------------------


@query("most_common_words", """
SELECT word, n FROM (
  SELECT word, count(*) AS n, min(doc_id) AS first_doc
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word)
ORDER BY n DESC, first_doc, word LIMIT 25
""")
def most_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of all texts; most words are rare and none of these is shuffled."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return most_common_bounded(words, "word", F.struct("doc_id", "word"), 25)


# Terms of each kind: two from the tables, the rest fixed.
_FIXED_TERMS = ((KEYWORD, "standard"), (KEYWORD, "hot gear"), (SKIP, "small"), (SKIP, "Ring"), (SKIP, "bolt"))


@query("tier_rule_table", f"""
WITH {PARTS_SQL},
terms AS (
  SELECT DISTINCT 'named' AS kind, lower(p_type || ' ' || p_brand) AS term FROM part WHERE p_size = 1
  UNION SELECT 'keyword', lower(p_name) FROM part WHERE p_size = 2
  UNION VALUES {', '.join(f"('{kind}', '{term.lower()}')" for kind, term in _FIXED_TERMS)}),
hits AS (
  SELECT p_partkey, min(CASE kind WHEN 'named' THEN 0 WHEN 'skip' THEN 1 ELSE 2 END) AS rank
  FROM parts JOIN terms ON contains(
    ' ' || lower(CASE kind WHEN 'named' THEN company_name WHEN 'skip' THEN title ELSE company_name || ' ' || title END) || ' ',
    ' ' || term || ' ')
  GROUP BY p_partkey)
SELECT p_partkey, CASE rank WHEN 0 THEN 'named_target' WHEN 2 THEN 'keyword' ELSE 'skip' END AS tier
FROM parts LEFT JOIN hits USING (p_partkey)
""")
def tier_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by a table of terms that grows with the parts."""
    part = table(spark, sf_dir, "part")
    kinds = F.lower(F.concat("p_type", F.lit(" "), "p_brand"))
    terms = part.filter("p_size = 1").select(F.lit(NAMED).alias("kind"), kinds.alias("term")).union(
        part.filter("p_size = 2").select(F.lit(KEYWORD), F.lower("p_name"))
    ).union(spark.createDataFrame(list(_FIXED_TERMS), "kind string, term string"))
    return tier_by_table(ad.parts_as_listings(spark, sf_dir), terms, "p_partkey")


_RULES_SQL = ", ".join(f"({n}, '{family}', {low}, {high})" for n, (family, low, high) in enumerate(ROLE_RANGES, 1))


@query("range_rules", f"""
WITH {SCORES_SQL}, rules(place, family, low, high) AS (VALUES {_RULES_SQL}),
s AS (SELECT r.family, q_score FROM scores JOIN rules r ON r.place = split_part(resume_version, '-', 2)::int)
SELECT r.family, low, high, count(s.q_score) AS covered,
  count(*) FILTER (q_score NOT BETWEEN low AND high) AS outside, count(*) FILTER (q_score > high) AS above,
  CASE WHEN count(s.q_score) > 0 THEN round(count(*) FILTER (q_score NOT BETWEEN low AND high) / count(s.q_score), 6) END
    AS outside_share,
  (SELECT count(*) FROM s x WHERE x.q_score BETWEEN r.low AND r.high) AS within
FROM rules r LEFT JOIN s ON s.family = r.family GROUP BY r.family, low, high
""")
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All role families' ranges as a table, joined with the scores; a line's number is its family."""
    rules = spark.createDataFrame(
        [(n, *rule) for n, rule in enumerate(ROLE_RANGES, 1)], "place int, family string, low int, high int"
    )
    scores = ad.scores_of_lineitem(spark, sf_dir).select(
        "qualification_score", F.split_part("resume_version", F.lit("-"), F.lit(2)).cast("int").alias("place")
    )
    named = scores.join(rules.select("place", F.col("family").alias("score_family")), "place")
    return range_rule_audit(named, "qualification_score", "score_family", rules.drop("place"))


# --- tables bucketed by listing ----------------------------------------------------------------------

def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    jobs, scores = ad.jobs_of_orders(spark, sf_dir), ad.scores_of_lineitem(spark, sf_dir)
    buckets = buckets_for(jobs, scores)
    return write_bucketed(jobs, "jobs", "job_id", buckets), write_bucketed(scores, "scores", "job_id", buckets)


@query("score_star_bucketed", f"""
WITH {JOBS_SQL}, {COMPANIES_SQL}, {SCORES_SQL}
SELECT job_id, profile_version, resume_version, name AS company, title, q_score, fit_score
FROM scores JOIN jobs USING (job_id) JOIN companies USING (company_id)
""")
def score_star_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with listing and company, from tables bucketed by listing."""
    jobs, scores = _bucketed(spark, sf_dir)
    found = review.bucketed_view(scores, jobs, ad.companies_of_customers(spark, sf_dir))
    return found.select("job_id", "profile_version", "resume_version", "company", "title", "q_score", "fit_score")


@query("unscored_bucketed", f"""
WITH {JOBS_SQL}
SELECT job_id, title FROM jobs WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'A'
    AND l_linestatus || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey LIKE 'F-1-%')
""")
def unscored_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings without a score of a version, from tables bucketed by listing."""
    jobs, scores = _bucketed(spark, sf_dir)
    done = scores.filter("profile_version = 'A' AND resume_version LIKE 'F-1-%'").withColumn("resume_version", F.lit("F"))
    return queue.unscored(jobs, done.hint("merge"), "A", "F").select("job_id", "title")


# --- streams of several micro-batches ---------------------------------------------------------------

SLICES = 8


@query("stream_dedup_expiry", f"""
WITH RECURSIVE listed AS (
  SELECT sha256(lang || '::' || trim(lower(text)) || '::')[:16] AS fingerprint, doc_id AS t,
    (doc_id - (SELECT min(doc_id) FROM documents)) * {SLICES}
      // ((SELECT max(doc_id) - min(doc_id) + 1 FROM documents)) AS b
  FROM documents),
spans AS (SELECT (max(t) - min(t) + 1) // 10 AS delay FROM listed),
marks AS (SELECT s.b, (SELECT max(t) FROM listed l WHERE l.b <= s.b - 2) AS seen FROM (SELECT DISTINCT b FROM listed) s),
kept AS (
  SELECT fingerprint, min(t) AS t FROM listed GROUP BY fingerprint
  UNION ALL
  SELECT l.fingerprint, min(l.t) FROM kept k JOIN listed l ON l.fingerprint = k.fingerprint AND l.t > k.t
    JOIN marks m ON m.b = l.b, spans
  WHERE k.t + 2 * delay <= m.seen GROUP BY l.fingerprint, k.t)
SELECT DISTINCT fingerprint, t AS doc_id FROM kept
""")
def stream_dedup_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of texts arriving in {SLICES} micro-batches; a content comes again once its state is gone.

    The delay is a tenth of the time that the texts span, so the state of early ones is dropped long before
    the end.
    """
    no_places = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents")
    listed = docs.select(
        "doc_id", tx.fingerprint(F.col("lang"), F.col("text"), no_places).alias("fingerprint"),
    )
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    folder = scratch_dir(spark, "dedup-slices")
    land_in_slices(listed, first_slice_of(listed, "doc_id", SLICES), f"{folder}/in")
    stream = read_slices(spark, f"{folder}/in", listed.schema)
    once = stream_dedup(stream, f"{(high - low + 1) // 10} seconds", F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")))
    rows = once.select("fingerprint", "doc_id")
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


ARRIVED = merge.MergeSpec(
    keys=("event_type", "user_id"), frozen=("first_value",), mutable=("value", "props", "seen_at"), late=("props",),
)


class Died(RuntimeError):
    """A run that ends after its state was written and before its checkpoint was."""


@query("stream_upsert_replay", """
SELECT event_type, user_id, arg_min(value, event_id) AS first_value,
  arg_max(value, event_id) AS value, arg_max(props, event_id) AS props,
  arg_max(epoch_us(ts), event_id) AS seen_at, min(event_id) AS first_seq,
  max(event_id) AS last_seq
FROM events GROUP BY event_type, user_id
""")
def stream_upsert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings arriving in micro-batches, folded into one state; the run dies once and a micro-batch is repeated."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", F.col("value").alias("first_value"), "value", "props",
        epoch_us("ts").alias("seen_at"),
    )
    folder = scratch_dir(spark, "upsert-slices")
    land_in_slices(events, first_slice_of(events, "event_id", SLICES), f"{folder}/in")
    died = []

    def die_once(batch_id: int) -> None:
        if batch_id == SLICES // 2 and not died:
            died.append(batch_id)
            raise Died(f"after micro-batch {batch_id}")

    def run() -> None:
        stream = merge.sightings(read_slices(spark, f"{folder}/in", events.schema), ARRIVED, F.col("event_id"))
        fold_stream(stream, ARRIVED, f"{folder}/state", f"{folder}/checkpoint", die_once).awaitTermination()

    try:
        run()
    except Exception:
        if not died:
            raise
        run()
    schema = merge.sightings(events, ARRIVED, F.col("event_id")).schema
    return folded_state(spark, f"{folder}/state", schema)
