"""Scans, normalization, enrichment and merge on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.catalog import adapters as ad
from listwright.catalog.adapters import FEED_SQL, sql_strip
from listwright.catalog.registry import epoch_us, query, table
from listwright.fixed_values import COMPANY_SUFFIXES, REQUIRED_FIELDS
from listwright.functions import payload as js, text as tx, urls
from listwright.operators import checks, merge
from listwright.operators import normalize as nz
from listwright.sources.arrays import read_ranges
from listwright.sources.feeds import as_raw, feed_status as status_of, union_all
from listwright.sources.scratch import scratch_dir

# --- scans ---------------------------------------------------------------------------------------


@query("source_union", """
SELECT 'documents' AS source, 0 AS source_ord, doc_id AS pos, CAST(length(text) AS BIGINT) AS size
  FROM documents
UNION ALL SELECT 'pages', 1, page_id, length(html) FROM pages
UNION ALL SELECT 'benchmark', 2, item_id, length(text) FROM benchmark
UNION ALL SELECT 'conversations', 3, conv_id * 1000000 + turn, length(text) FROM conversations
""")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = (
        ("documents", F.col("doc_id"), "text"),
        ("pages", F.col("page_id"), "html"),
        ("benchmark", F.col("item_id"), "text"),
        ("conversations", F.col("conv_id") * 1000000 + F.col("turn"), "text"),
    )
    return union_all([
        table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), F.lit(ordinal).alias("source_ord"), pos.alias("pos"),
            F.length(body).cast("bigint").alias("size"),
        )
        for ordinal, (name, pos, body) in enumerate(registry)
    ])


@query("source_kept_skipped", f"""
WITH {FEED_SQL}
SELECT source, count(*) FILTER (visible AND complete) AS kept,
  count(*) FILTER (NOT (visible AND complete)) AS skipped, CAST(0 AS BIGINT) AS bad,
  count(*) AS total
FROM feed GROUP BY source
""")
def source_kept_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.verdict_counts(ad.judged(spark, sf_dir))


@query("count_by_source", f"""
WITH {FEED_SQL} SELECT source, count(*) AS n FROM listing GROUP BY source
""")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.count_by(ad.kept(spark, sf_dir), "source")


@query("most_common", """
SELECT customer, n FROM (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS customer,
    count(*) AS n, min(o_orderkey) AS first_key
  FROM orders GROUP BY 1)
ORDER BY n DESC, first_key LIMIT 10
""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("customer"),
    )
    return nz.most_common(orders, "customer", F.col("o_orderkey"), 10)


@query("first_row", f"""
WITH {FEED_SQL}
SELECT source, source_id, company_name, season, active, url FROM listing ORDER BY seq LIMIT 1
""")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.kept(spark, sf_dir).select(
        "source", "source_id", "company_name", "season", "active", "url", "raw_payload", "seq"
    )
    return nz.first_row(rows, F.col("seq"), "raw_payload").drop("seq")


# --- normalization -------------------------------------------------------------------------------


def _feed_docs(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return nz.parse(ad.feed_payloads(spark, sf_dir), fields).select("pos", "doc")


@query("visible_filter", f"WITH {FEED_SQL} SELECT pos FROM feed WHERE visible")
def visible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, "is_visible")
    return docs.filter(nz.is_visible(F.col("doc"))).select("pos")


@query("required_fields", f"WITH {FEED_SQL} SELECT pos FROM feed WHERE complete")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, *REQUIRED_FIELDS)
    return docs.filter(nz.has_required(F.col("doc"))).select("pos")


@query("season_coalesce", f"WITH {FEED_SQL} SELECT pos, season FROM feed")
def season_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, "season", "terms")
    return docs.select("pos", nz.season_of(F.col("doc")).alias("season"))


@query("array_default", f"""
WITH {FEED_SQL}
SELECT pos, array_to_string(locations, '|') AS locations,
  CAST(len(locations) AS INTEGER) AS n_locations, 0 AS n_degrees
FROM feed
""")
def array_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, "locations", "degrees")
    places = js.as_strings(F.col("doc.locations"))
    degrees = js.as_strings(F.col("doc.degrees"))
    return docs.select(
        "pos", F.array_join(places, "|").alias("locations"),
        F.size(places).alias("n_locations"), F.size(degrees).alias("n_degrees"),
    )


@query("active_flag", f"WITH {FEED_SQL} SELECT pos, active FROM feed")
def active_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, "active")
    return docs.select("pos", nz.is_active(F.col("doc")).alias("active"))


@query("empty_to_null", f"WITH {FEED_SQL} SELECT pos, company_url FROM feed")
def empty_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _feed_docs(spark, sf_dir, "company_url")
    given = js.as_text(F.col("doc.company_url"))
    return docs.select("pos", tx.or_null(given).alias("company_url"))


@query("text_normalize", f"""
SELECT doc_id, {sql_strip("chr(9) || '  ' || text || chr(160) || chr(10) || chr(8195)")} AS body,
  {sql_strip("chr(12) || source || ' '")} AS source
FROM documents
""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t  "), "text", F.lit(" \n "))
    source = F.concat(F.lit("\f"), "source", F.lit(" "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.strip(padded).alias("body"), tx.strip(source).alias("source")
    )


@query("payload_rederive", f"""
WITH {FEED_SQL} SELECT source, source_id, pos, n_chars AS size, category FROM listing
""")
def payload_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read a field that the normalized schema never had out of the stored payload."""
    rows = ad.kept(spark, sf_dir).select("source", "source_id", "seq.pos", "raw_payload")
    doc = js.parse_fields(F.col("raw_payload"), ("extra", "category"))
    parsed = rows.select("source", "source_id", "pos", js.evaluated_once(doc).alias("doc"))
    return parsed.select(
        "source", "source_id", "pos",
        F.try_variant_get("doc.extra", "$.size", "bigint").alias("size"),
        js.as_text(F.col("doc.category")).alias("category"),
    )


@query("payload_number", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def payload_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return events.select(
        "event_id", js.as_long(js.parse_fields(F.col("props"), ("k",))["k"]).alias("k")
    )


@query("normalized_listings", f"""
WITH {FEED_SQL}
SELECT source, source_id, pos, company_name, title, url,
  array_to_string(locations, '|') AS locations, season, category, active, posted_at, company_url
FROM listing
""")
def normalized_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.kept(spark, sf_dir).select(
        "source", "source_id", "seq.pos", "company_name", "title", "url",
        F.array_join("locations", "|").alias("locations"), "season", "category", "active",
        "posted_at", "company_url",
    )


# --- enrichment ----------------------------------------------------------------------------------

# Tracking hosts put in place of the pages' own, and the pages' own as a rule table.
PAGE_RULES = (
    ("commercial", "suffix", ".example.com", "label"),
    ("network", "suffix", ".example.net", "path"),
    ("organization", "suffix", ".example.org", "none"),
)
_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)', 1))"
_SEGMENTS_SQL = (
    "list_filter(string_split(regexp_replace("
    "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), "
    "lambda x: x <> '')"
)
_ATS_URL_SQL = (
    "replace(replace(replace(url, '.example.com', '.icims.com'), '.example.net', "
    "'.smartrecruiters.com'), '.example.org', '.taleo.net')"
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ats_url = F.replace(F.col("url"), F.lit(".example.com"), F.lit(".icims.com"))
    ats_url = F.replace(ats_url, F.lit(".example.net"), F.lit(".smartrecruiters.com"))
    ats_url = F.replace(ats_url, F.lit(".example.org"), F.lit(".taleo.net"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", ats_url.alias("ats_url"))
    return pages.select(
        "page_id", urls.host(F.col("url")).alias("host"),
        urls.path_segments(F.col("url")).alias("segments"),
        urls.host(F.col("ats_url")).alias("ats_host"),
        urls.path_segments(F.col("ats_url")).alias("ats_segments"),
    )


@query("url_host", f"SELECT page_id, {_HOST_SQL} AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "host")


@query("url_path_segments", f"""
SELECT page_id, array_to_string({_SEGMENTS_SQL}, '|') AS segments,
  CAST(len({_SEGMENTS_SQL}) AS INTEGER) AS n
FROM pages
""")
def url_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id", F.array_join("segments", "|").alias("segments"), F.size("segments").alias("n")
    )


@query("url_provider", f"""
WITH hosts AS (SELECT page_id, {_HOST_SQL} AS host FROM pages)
SELECT page_id,
  CASE WHEN ends_with(host, '.example.com') THEN 'commercial'
    WHEN ends_with(host, '.example.net') THEN 'network'
    WHEN ends_with(host, '.example.org') THEN 'organization' END AS provider,
  CASE WHEN ends_with(host, '.example.com') THEN 'icims'
    WHEN ends_with(host, '.example.net') THEN 'smartrecruiters'
    WHEN ends_with(host, '.example.org') THEN 'taleo' END AS ats_provider
FROM hosts
""")
def url_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.provider_of(F.col("host"), PAGE_RULES).alias("provider"),
        urls.provider_of(F.col("ats_host")).alias("ats_provider"),
    )


@query("url_token", f"""
WITH hosts AS (SELECT page_id, {_HOST_SQL} AS host, {_SEGMENTS_SQL} AS segments FROM pages)
SELECT page_id,
  CASE WHEN ends_with(host, '.example.com') THEN string_split(host, '.')[1]
    WHEN ends_with(host, '.example.net') THEN segments[1] END AS token,
  CASE WHEN ends_with(host, '.example.net') THEN segments[1]
    ELSE string_split(host, '.')[1] END AS ats_token
FROM hosts
""")
def url_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.token_of(F.col("host"), F.col("segments"), PAGE_RULES).alias("token"),
        urls.token_of(F.col("ats_host"), F.col("ats_segments")).alias("ats_token"),
    )


def _key_sql(name: str) -> str:
    """Nested selects, one per suffix, ending in column k."""
    step = f"SELECT c_custkey, {sql_strip(f'lower({name})')} AS k FROM customer"
    for suffix in COMPANY_SUFFIXES:
        size = len(suffix)
        cut = sql_strip(f"k[1:length(k) - {size}]")
        step = (
            f"SELECT c_custkey, CASE WHEN ends_with(k, '{suffix}') THEN {cut} ELSE k END AS k "
            f"FROM ({step})"
        )
    return step


_NAME_SQL = """'  ' || c_name || CASE c_custkey % 9 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corporation, Inc.'
  WHEN 2 THEN ' Inc, LLC' WHEN 3 THEN ', Corporation' WHEN 4 THEN ' Corp' WHEN 5 THEN ' LTD. '
  WHEN 6 THEN ' Ltd, Inc' WHEN 7 THEN ' corp. llc inc.' ELSE ' Incorporated' END"""


@query("company_key", f"SELECT c_custkey, k AS company_key FROM ({_key_sql(_NAME_SQL)})")
def company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = (
        ", Inc.", " Corporation, Inc.", " Inc, LLC", ", Corporation", " Corp", " LTD. ",
        " Ltd, Inc", " corp. llc inc.", " Incorporated",
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = F.concat(F.lit("  "), "c_name", F.get(
        F.array(*map(F.lit, suffixes)), (F.col("c_custkey") % len(suffixes)).cast("int")
    ))
    return customers.select("c_custkey", tx.company_key(name).alias("company_key"))


_FINGERPRINT_SQL = f"""
sha256(name_normalized || '::' || {sql_strip("lower(title)")} || '::' ||
  array_to_string(list_sort(list_transform(locations, lambda x: {sql_strip("lower(x)")})), '|')
)[:16]"""


@query("content_fingerprint", f"""
WITH {FEED_SQL} SELECT pos, {_FINGERPRINT_SQL} AS fingerprint FROM listing
""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.enriched(spark, sf_dir).select("seq.pos", "fingerprint")


@query("cross_source_duplicates", """
SELECT sha256(lang || '::' || trim(lower(text)) || '::')[:16] AS fingerprint,
  CAST(count(DISTINCT source) AS INTEGER) AS n_sources, count(*) AS copies,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1
""")
def cross_source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_places = F.array().cast("array<string>")
    listed = table(spark, sf_dir, "documents").select(
        tx.fingerprint(F.col("lang"), F.col("text"), no_places).alias("fingerprint"), "source"
    )
    return nz.same_content_across_sources(listed, "fingerprint", "source")


@query("version_hash", "SELECT doc_id, sha256(text)[:12] AS version FROM documents")
def version_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.version_hash(F.col("text")).alias("version")
    )


@query("array_file_ranges", f"""
WITH {FEED_SQL}, objects AS (
  SELECT source, CASE WHEN pos % 23 = 5 THEN '' ELSE source_id END AS source_id, row_number() OVER (
    PARTITION BY source, pos // 5000 ORDER BY pos) AS place, pos // 5000 AS part
  FROM feed)
SELECT source, part, CAST(place AS BIGINT) AS pos, source_id FROM objects
""")
def array_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed objects, landed as files of one array for each 5,000 ids of a feed and read by byte ranges."""
    folder = f"{scratch_dir(spark, 'array-files')}/feeds"
    objects = ad.feed_payloads(spark, sf_dir).select("source", "pos", "payload", F.floor(F.col("pos") / 5000).alias("part"))
    # The first element of an array opens it; the objects follow, each after a comma.
    opened = objects.select("source", "part").distinct().select(
        "source", F.lit(-1).cast("bigint").alias("pos"), F.lit('["feed"').alias("value"), "part"
    )
    closed = opened.select("source", F.lit(2**62).alias("pos"), F.lit("]").alias("value"), "part")
    lines = objects.select("source", "pos", F.concat(F.lit(","), "payload").alias("value"), "part").union(opened).union(closed)
    placed = lines.repartition("source", "part").sortWithinPartitions("source", "part", "pos")
    placed.select("source", "part", "value").write.partitionBy("source", "part").text(folder, lineSep=" ")
    found = read_ranges(spark, spark.read.option("lineSep", "}").text(folder)).filter("pos > 0")
    doc = js.parse_fields(F.col("payload"), ("id",))
    return found.select(
        F.regexp_extract("file", "source=([^/]*)/", 1).alias("source"),
        F.regexp_extract("file", "part=([^/]*)/", 1).cast("bigint").alias("part"), "pos",
        js.as_text(doc["id"]).alias("source_id"),
    )


# --- merge ---------------------------------------------------------------------------------------

SIGHTING = merge.MergeSpec(
    keys=("event_type", "user_id"),
    frozen=("first_value", "fingerprint"),
    mutable=("value", "props", "seen_at"),
    late=("props",),
)
# Events before this moment are the stored state, the rest is the batch that is merged into it.
BATCH_START = "2024-01-16"


def _state_and_batch(
    spark: SparkSession, sf_dir: str, spec: merge.MergeSpec = SIGHTING
) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", "value", F.col("value").alias("first_value"),
        "props", tx.sha256_prefix(F.col("props"), 16).alias("fingerprint"),
        epoch_us("ts").alias("seen_at"),
        (F.col("ts") >= F.lit(BATCH_START).cast("timestamp_ntz")).alias("is_batch"),
    )

    def shaped(rows: DataFrame) -> DataFrame:
        return merge.sightings(rows, spec, F.col("event_id"))

    stored = merge.fold(shaped(events.filter(~F.col("is_batch"))), spec)
    return stored, shaped(events.filter("is_batch"))


def _merged(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    spec = SIGHTING.only(columns or None)
    stored, batch = _state_and_batch(spark, sf_dir, spec)
    return merge.upsert(stored, batch, spec)


@query("listing_upsert", """
SELECT event_type, user_id, arg_min(value, event_id) AS first_value,
  arg_max(value, event_id) AS value, arg_max(props, event_id) AS props,
  min(event_id) AS first_seq, max(event_id) AS last_seq
FROM events GROUP BY event_type, user_id
""")
def listing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select(
        "event_type", "user_id", "first_value", "value", "props", "first_seq", "last_seq"
    )


@query("upsert_frozen_columns", """
SELECT event_type, user_id, arg_min(sha256(props)[:16], event_id) AS fingerprint,
  arg_max(sha256(props)[:16], event_id) AS fingerprint_current,
  arg_min(sha256(props)[:16], event_id) <> arg_max(sha256(props)[:16], event_id) AS is_stale
FROM events GROUP BY event_type, user_id
""")
def upsert_frozen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = tx.sha256_prefix(F.col("props"), 16)
    return _merged(spark, sf_dir).select(
        "event_type", "user_id", "fingerprint", current.alias("fingerprint_current"),
        (F.col("fingerprint") != current).alias("is_stale"),
    )


@query("last_seen", """
SELECT event_type, user_id, arg_max(epoch_us(ts), event_id) AS last_seen_at
FROM events GROUP BY event_type, user_id
""")
def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "seen_at").select(
        "event_type", "user_id", F.col("seen_at").alias("last_seen_at")
    )


@query("upsert_stats", f"""
WITH per_key AS (
  SELECT event_type, user_id, bool_or(ts < TIMESTAMP '{BATCH_START}') AS known,
    count(*) FILTER (ts >= TIMESTAMP '{BATCH_START}') AS seen
  FROM events GROUP BY event_type, user_id)
SELECT CAST(sum(seen) AS BIGINT) AS total_seen, count(*) FILTER (NOT known AND seen > 0) AS inserted,
  CAST(sum(seen) - count(*) FILTER (NOT known AND seen > 0) AS BIGINT) AS updated
FROM per_key
""")
def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while the merged state is written."""
    stored, batch = _state_and_batch(spark, sf_dir)
    merged, counted = merge.upsert_counted(stored, batch, SIGHTING)
    merged.write.parquet(scratch_dir(spark, "merged"))
    names = ("total_seen", "inserted", "updated")
    return spark.createDataFrame([tuple(counted.get[c] for c in names)], ", ".join(f"{c} bigint" for c in names))


@query("upsert_key_stats", f"""
WITH per_key AS (
  SELECT event_type, user_id, bool_or(ts < TIMESTAMP '{BATCH_START}') AS known,
    count(*) FILTER (ts >= TIMESTAMP '{BATCH_START}') AS seen
  FROM events GROUP BY event_type, user_id)
SELECT CAST(sum(seen) AS BIGINT) AS total_seen, count(*) FILTER (NOT known AND seen > 0) AS inserted,
  CAST(sum(seen) - count(*) FILTER (NOT known AND seen > 0) AS BIGINT) AS updated
FROM per_key
""")
def upsert_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts before anything is merged, from keys alone."""
    stored, batch = _state_and_batch(spark, sf_dir, SIGHTING.only(()))
    return merge.merge_stats(stored, batch, SIGHTING.keys)


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return merge.fold_companies(merge.company_sightings(ad.enriched(spark, sf_dir), run_at))


@query("dim_get_or_create", f"""
WITH {FEED_SQL}
SELECT name_normalized, company_name AS name, company_url FROM listing
QUALIFY row_number() OVER (PARTITION BY name_normalized ORDER BY seq) = 1
""")
def dim_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("name_normalized", "name", "company_url")


@query("first_nonnull_backfill", f"""
WITH {FEED_SQL}
SELECT name_normalized, ats_provider, ats_token FROM listing
QUALIFY row_number() OVER (
  PARTITION BY name_normalized ORDER BY ats_provider IS NULL, seq) = 1
""")
def first_nonnull_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("name_normalized", "ats_provider", "ats_token")


PULLED_JOBS_SQL = f"""
WITH {FEED_SQL},
ranked AS (
  SELECT *, {_FINGERPRINT_SQL} AS fingerprint,
    row_number() OVER (PARTITION BY source, source_id ORDER BY seq) AS up,
    row_number() OVER (PARTITION BY source, source_id ORDER BY seq DESC) AS down
  FROM listing)
SELECT l.source, l.source_id, f.fingerprint, f.name_normalized AS company, l.title, l.url,
  l.ats_provider, l.ats_token, l.season, l.active, l.posted_at,
  array_to_string(l.locations, '|') AS locations, f.pos AS first_pos, l.pos AS last_pos
FROM ranked l JOIN ranked f ON f.source = l.source AND f.source_id = l.source_id AND f.up = 1
WHERE l.down = 1
"""


@query("pulled_jobs", PULLED_JOBS_SQL)
def pulled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs table after a pull of all feeds, joined to its company key."""
    run_at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    listings = ad.enriched(spark, sf_dir)
    jobs = merge.fold_jobs(merge.job_sightings(listings, run_at))
    keys = listings.select("company_id", "name_normalized").distinct()
    return jobs.join(keys, "company_id").select(
        "source", "source_id", "fingerprint", F.col("name_normalized").alias("company"), "title",
        "url", "ats_provider", "ats_token", "season", "active", "posted_at",
        F.array_join("locations", "|").alias("locations"),
        F.col("first_seq.pos").alias("first_pos"), F.col("last_seq.pos").alias("last_pos"),
    )


# --- checks --------------------------------------------------------------------------------------

_RELATIONS = (
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("pages", "page_id", "conversations", "conv_id"),
)


@query("orphan_check", " UNION ALL ".join(
    f"SELECT '{child}.{fk}' AS relation, count(*) AS orphans FROM {child} "
    f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = {child}.{fk})"
    for child, fk, parent, key in _RELATIONS
))
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([
        checks.orphan_count(
            table(spark, sf_dir, child), fk, table(spark, sf_dir, parent), key
        ).select(F.lit(f"{child}.{fk}").alias("relation"), "orphans")
        for child, fk, parent, key in _RELATIONS
    ])


@query("duplicate_key_check", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("null_check", f"""
WITH {FEED_SQL}
SELECT 'season' AS column_name, count(*) FILTER (season IS NULL) AS nulls FROM listing
UNION ALL SELECT 'company_url', count(*) FILTER (company_url IS NULL) FROM listing
UNION ALL SELECT 'title', count(*) FILTER (title IS NULL) FROM listing
""")
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.null_violations(ad.kept(spark, sf_dir), ("season", "company_url", "title"))


@query("stale_keys", """
WITH state AS (
  SELECT event_type, user_id, max(CAST(ts AS DATE)) AS seen FROM events GROUP BY ALL)
SELECT event_type, user_id, CAST(seen AS VARCHAR) AS last_seen
FROM state JOIN (SELECT event_type, max(seen) AS latest FROM state GROUP BY ALL) USING (event_type)
WHERE seen < latest
""")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys not sighted on the latest day of their source."""
    seen = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        F.max(F.to_date("ts")).alias("last_seen")
    )
    stale = checks.stale(seen, "event_type", "last_seen")
    return stale.withColumn("last_seen", F.col("last_seen").cast("string"))


def _feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a feed file of three elements; every fifth is not an array."""
    array = F.concat(
        F.lit('[{"id":'), F.col("doc_id").cast("string"), F.lit('}, "{\\"id\\":1}", '),
        F.col("n_chars").cast("string"), F.lit("]"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("source"), F.lit(0).alias("source_ord"),
        F.col("doc_id").cast("string").alias("file"),
        F.when(F.col("doc_id") % 5 == 0, F.lit('{"listings":[]}')).otherwise(array).alias("document"),
    )


_FILES_SQL = """
SELECT lang AS source, doc_id::varchar AS file, pos, CASE pos WHEN 0 THEN '{"id":' || doc_id || '}'
  WHEN 1 THEN '"{\\"id\\":1}"' ELSE n_chars::varchar END AS payload, 'ok' AS feed_status
FROM documents, (VALUES (0), (1), (2)) AS p(pos) WHERE doc_id % 5 <> 0
UNION ALL SELECT lang, doc_id::varchar, NULL, NULL, 'failed' FROM documents WHERE doc_id % 5 = 0
"""


@query("feed_array_split", _FILES_SQL)
def feed_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files split into their elements; a text stays a text, a broken file is marked."""
    return as_raw(_feed_files(spark, sf_dir), "array").select(
        "source", "file", "pos", "payload", "feed_status"
    )


@query("feed_status", f"""
SELECT source, file, max(feed_status = 'failed')::int AS failed, count(pos) AS listings
FROM ({_FILES_SQL}) GROUP BY source, file
""")
def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which feed files could be read, and how many elements they hold."""
    files = status_of(as_raw(_feed_files(spark, sf_dir), "array"))
    return files.select("source", "file", (F.col("status") == "failed").cast("int").alias("failed"), "listings")
