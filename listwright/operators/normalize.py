"""Raw feed objects -> normalized listings, with the verdict on every object kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import REQUIRED_FIELDS
from listwright.functions import payload as js, text as tx, urls
from listwright.sources.feeds import FEED_FAILED

KEPT, SKIPPED, BAD, FEED_MARKER = "kept", "skipped", "bad", "feed"


# Fields the normalized shape is made from.
FIELDS = (
    *REQUIRED_FIELDS, "is_visible", "active", "season", "terms", "locations", "degrees", "category",
    "sponsorship", "date_posted", "date_updated", "company_url",
)


def parse(raw: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add ``doc``, the payload's fields; each payload is parsed once.

    The generator hides from the optimizer which fields are used, so name those that are.
    """
    return raw.select(
        "*", js.evaluated_once(js.parse_fields(F.col("payload"), fields)).alias("doc")
    )


def is_visible(doc: Column) -> Column:
    """Absent counts as visible; a present null, false, zero or empty value does not."""
    return js.is_truthy(doc["is_visible"], when_absent=True)


def is_active(doc: Column) -> Column:
    """Same reading as visibility; inactive listings are kept."""
    return js.is_truthy(doc["active"], when_absent=True)


def has_required(doc: Column, fields: tuple[str, ...] = REQUIRED_FIELDS) -> Column:
    """All required fields truthy before any trimming, so a blank title passes."""
    present = F.lit(True)
    for name in fields:
        present = present & js.is_truthy(doc[name])
    return present


def season_of(doc: Column) -> Column:
    """The season if it is truthy, else the first term as it stands, else null."""
    named = F.when(js.is_truthy(doc["season"]), js.as_text(doc["season"]))
    return F.coalesce(named, F.get(js.as_strings(doc["terms"]), F.lit(0)))


def problem_of(doc: Column) -> Column:
    """Why an object that is not skipped cannot become a listing, or null."""

    problem = F.when(js.is_kind(doc["id"], "ARRAY", "OBJECT"), F.lit("id type"))
    for name in ("company_name", "title", "url"):
        problem = problem.when(~js.is_kind(doc[name], "STRING"), F.lit(f"{name} type"))
    places = doc["locations"]
    # A null among texts does not show in the list's schema.
    all_texts = (F.schema_of_variant(places) == "ARRAY<STRING>") & ~F.exists(
        js.as_strings(places), lambda place: place.isNull()
    )
    problem = problem.when(
        js.is_truthy(places) & ~all_texts, F.lit("locations type")
    ).when(js.as_strings(doc["degrees"]).isNull(), F.lit("degrees type"))
    for name in ("season", "category", "sponsorship"):
        problem = problem.when(
            js.is_truthy(doc[name]) & js.is_kind(doc[name], "ARRAY", "OBJECT"), F.lit(f"{name} type")
        )
    for name in ("date_posted", "date_updated"):
        # A number of seconds, absent or null; anything else would lose what it says.
        problem = problem.when(
            doc[name].isNotNull() & ~js.is_kind(doc[name], "BIGINT", "VOID"), F.lit(f"{name} type")
        )
    return problem


def normalize(raw: DataFrame, batch_id: int | Column) -> DataFrame:
    """Normalized listing columns plus ``verdict`` and ``reason`` for every raw row.

    Nothing is dropped here: callers write the result partitioned by verdict, so the payload is
    parsed once and counts, dead letters and listings all read what was written.
    """
    doc = F.col("doc")
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    not_an_object = F.col("payload").isNull() | doc["broken"].isNotNull()
    reason = (
        F.when(F.col("feed_status") == FEED_FAILED, F.lit("feed not readable"))
        .when(F.col("pos").isNull(), F.lit("empty feed"))
        .when(not_an_object, F.lit("not an object"))
        .otherwise(problem_of(doc))
    )
    checked = parse(raw).select("*", reason.alias("reason"))
    verdict = (
        F.when(F.col("pos").isNull(), F.lit(FEED_MARKER))
        .when(not_an_object, F.lit(BAD))
        .when(~(is_visible(doc) & has_required(doc)), F.lit(SKIPPED))
        .when(F.col("reason").isNotNull(), F.lit(BAD))
        .otherwise(F.lit(KEPT))
    )
    return checked.select(
        "source",
        js.as_text(doc["id"]).alias("source_id"),
        tx.strip(js.as_text(doc["company_name"])).alias("company_name"),
        tx.strip(js.as_text(doc["title"])).alias("title"),
        js.as_text(doc["url"]).alias("url"),
        js.as_strings(doc["locations"]).alias("locations"),
        season_of(doc).alias("season"),
        js.as_text(doc["category"]).alias("category"),
        js.as_strings(doc["degrees"]).alias("degrees"),
        js.as_text(doc["sponsorship"]).alias("sponsorship"),
        is_active(doc).alias("active"),
        js.as_long(doc["date_posted"]).alias("posted_at"),
        js.as_long(doc["date_updated"]).alias("updated_at"),
        tx.or_null(js.as_text(doc["company_url"])).alias("company_url"),
        F.col("payload").alias("raw_payload"),
        F.struct(
            batch.cast("bigint").alias("batch_id"), "source_ord", "file", "pos"
        ).alias("seq"),
        "feed_status", verdict.alias("verdict"), "reason",
    )


def enrich(listings: DataFrame) -> DataFrame:
    """Add the company key, the fingerprint, the ids and what the URL says about the provider."""
    keyed = listings.select(
        "*",
        tx.company_key(F.col("company_name")).alias("name_normalized"),
        urls.host(F.col("url")).alias("_host"),
        urls.path_segments(F.col("url")).alias("_segments"),
    )
    return keyed.select(
        *(F.col(c) for c in keyed.columns if c not in ("_host", "_segments")),
        tx.fingerprint(
            F.col("name_normalized"), F.col("title"), F.col("locations")
        ).alias("fingerprint"),
        tx.natural_id(F.col("source"), F.col("source_id")).alias("job_id"),
        tx.natural_id(F.col("name_normalized")).alias("company_id"),
        urls.provider_of(F.col("_host")).alias("ats_provider"),
        urls.token_of(F.col("_host"), F.col("_segments")).alias("ats_token"),
    )


def verdict_counts(judged: DataFrame, key: str = "source") -> DataFrame:
    """Kept, skipped, bad and total objects per feed."""

    def count(*verdicts: str) -> Column:
        return F.count_if(F.col("verdict").isin(*verdicts))

    return judged.groupBy(key).agg(
        count(KEPT).alias("kept"),
        count(SKIPPED).alias("skipped"),
        count(BAD).alias("bad"),
        count(KEPT, SKIPPED, BAD).alias("total"),
    )


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, value: str, seq: Column, k: int) -> DataFrame:
    """The k most frequent values, null included; ties go to the value seen first."""
    return (
        rows.groupBy(value)
        .agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
        .orderBy(F.desc("n"), F.asc("_first"))
        .limit(k)
        .drop("_first")
    )


def first_row(rows: DataFrame, seq: Column, without: str) -> DataFrame:
    """The first row in arrival order, without one (wide) column."""
    return rows.drop(without).orderBy(seq).limit(1)


def same_content_across_sources(listings: DataFrame, content: str, source: str) -> DataFrame:
    """Content keys that occur in more than one source.

    One exchange on the content key. The set kept per key holds source names only, so its size is
    that of the feed registry however many copies a key has, and it is merged before the exchange.
    """
    grouped = listings.groupBy(content).agg(
        F.collect_set(source).alias("_sources"), F.count("*").alias("copies")
    )
    return grouped.filter(F.size("_sources") > 1).select(
        content,
        F.size("_sources").alias("n_sources"),
        "copies",
        F.array_join(F.array_sort("_sources"), ",").alias("sources"),
    )
