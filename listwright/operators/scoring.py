"""Scoring: rendering requests, calling the scorer, parsing and storing its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from listwright import schemas
from listwright.fixed_values import MANDATORY, OPTIONAL, UNSPECIFIED
from listwright.functions import payload as js, text as tx

SCORE_KEY = ("job_id", "profile_version", "resume_version")
FENCE = "```"

# A scorer takes one request text and returns one response text. The factory is called once per
# task, so a client or a model is opened once for all rows of the task.
Scorer = Callable[[str], str]
ScorerFactory = Callable[[], Scorer]

RESPONSE_SCHEMA = "job_id string, tier string, response string, error string"


@dataclass(frozen=True)
class RequestTemplate:
    """What every request says around the listing."""

    instructions: str = (
        "Rate one listing for the candidate described below. Answer with a single JSON object "
        "holding qualification_score and fit_score (integers from 0 to 100, judged separately), "
        "class_year_eligible (true or false), top_matches and top_gaps (lists of short texts), "
        "fit_reasoning and summary (one sentence each). Judge only what the documents show."
    )
    profile: str = ""
    resume: str = ""

    def header(self) -> str:
        return (
            f"{self.instructions}\n\nPROFILE\n{self.profile}\n\nRESUME\n{self.resume}\n\nLISTING\n"
        )


def render_listing(
    company: Column, title: Column, locations: Column, season: Column, sponsorship: Column,
    url: Column,
) -> Column:
    """The part of a request that differs from row to row."""
    return F.concat(
        F.lit("company: "), company,
        F.lit("\ntitle: "), title,
        F.lit("\nlocations: "), F.coalesce(F.array_join(locations, ", "), F.lit("")),
        F.lit("\nseason: "), tx.or_default(season, UNSPECIFIED),
        F.lit("\nsponsorship: "), tx.or_default(sponsorship, UNSPECIFIED),
        F.lit("\nurl: "), url,
    )


def render_request(template: RequestTemplate, listing: Column) -> Column:
    """The whole request. Its fixed part is a literal, so it is written once per plan."""
    return F.concat(F.lit(template.header()), listing)


def call_scorer(queue: DataFrame, factory: ScorerFactory, template: RequestTemplate) -> DataFrame:
    """One scorer call per queue row.

    Only the listing part of each request crosses to Python; the fixed part travels once with the
    task. A call that fails becomes a row with an error, and the others go on. The result must be
    written before it is used: reading it twice would call the scorer twice.
    """
    header = template.header()

    def one(scorer: Scorer, listing: str) -> tuple[str | None, str | None]:
        try:
            return scorer(header + listing), None
        except Exception as failure:  # a failed call must not stop the rest
            return None, f"{type(failure).__name__}: {failure}"

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            results = [one(scorer, listing) for listing in batch["listing"]]
            yield pd.DataFrame({
                "job_id": batch["job_id"],
                "tier": batch["tier"],
                "response": [response for response, _ in results],
                "error": [error for _, error in results],
            })

    requests = queue.select(
        F.col("job_id").cast("string").alias("job_id"), "tier",
        render_listing(
            F.col("company_name"), F.col("title"), F.col("locations"), F.col("season"),
            F.col("sponsorship"), F.col("url"),
        ).alias("listing"),
    )
    return requests.mapInPandas(score_batches, RESPONSE_SCHEMA)


def strip_fences(text: Column) -> Column:
    """Text between the first two code fences if the answer starts with one; else as it is."""
    bare = tx.strip(text)
    inner = F.split_part(bare, F.lit(FENCE), F.lit(2))
    unlabelled = F.when(inner.startswith("json"), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    return F.when(bare.startswith(FENCE), tx.strip(unlabelled)).otherwise(bare)


def _whole_score(node: Column) -> Column:
    """An integer from 0 to 100; null for text, fractions and anything out of range."""
    return F.when(
        js.is_kind(node, "BIGINT") & js.as_long(node).between(0, 100), js.as_long(node).cast("int")
    )


def parse_response(responses: DataFrame) -> DataFrame:
    """Add the parsed answer and, where it cannot be stored, the reason in ``error``.

    Scores, eligibility and both lists must be present. Eligibility is read by truthiness. Reasoning
    and summary are optional.
    """
    listed = js.parse_single_object(strip_fences(F.col("response")), MANDATORY + OPTIONAL)
    read = responses.select("*", js.evaluated_once(listed).alias("_listed"))
    answers = read.select("*", js.single_object(F.col("_listed")).alias("_answer"))
    answer = F.col("_answer")
    absent = F.lit(False)
    for name in MANDATORY:
        absent = absent | answer[name].isNull()
    values = answers.select(
        *responses.columns,
        answer.isNull().alias("_not_one"),
        absent.alias("_absent"),
        _whole_score(answer["qualification_score"]).alias("qualification_score"),
        _whole_score(answer["fit_score"]).alias("fit_score"),
        js.is_truthy(answer["class_year_eligible"]).alias("class_year_eligible"),
        js.as_strings(answer["top_matches"]).alias("top_matches"),
        js.as_strings(answer["top_gaps"]).alias("top_gaps"),
        js.as_text(answer["fit_reasoning"]).alias("fit_reasoning"),
        js.as_text(answer["summary"]).alias("summary"),
    )
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("response").isNull(), F.lit("no response"))
        .when(F.col("_not_one"), F.lit("not one JSON object"))
        .when(F.col("_absent"), F.lit("missing field"))
        .when(F.col("qualification_score").isNull() | F.col("fit_score").isNull(),
              F.lit("score not an integer from 0 to 100"))
        .when(F.col("top_matches").isNull() | F.col("top_gaps").isNull(),
              F.lit("list field of another type"))
    )
    return values.withColumn("error", problem).drop("_not_one", "_absent")


def parsed_ok(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull())


def parsed_failed(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def outcome_counts(parsed: DataFrame) -> DataFrame:
    """How many answers were scored and how many failed."""
    return parsed.agg(
        F.count_if(F.col("error").isNull()).alias("scored"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def insert_or_ignore(
    stored: DataFrame, batch: DataFrame, key: tuple[str, ...], seq: Column,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of the batch that an append should add.

    The first row of each key wins, a key already stored is left alone, and a row that lacks a
    required value is not stored.
    """
    complete = batch
    for name in required:
        complete = complete.filter(F.col(name).isNotNull())
    rest = [c for c in batch.columns if c not in key]
    first = complete.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("_row"))
    fresh = first.join(stored.select(*key).distinct(), list(key), "left_anti")
    return fresh.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def as_match_scores(
    parsed: DataFrame, profile_version: str, resume_version: str, model: str, created_at: Column,
    batch_id: int,
) -> DataFrame:
    """Parsed answers in the schema of the score table."""
    rows = parsed.select(
        "*",
        F.lit(profile_version).alias("profile_version"),
        F.lit(resume_version).alias("resume_version"),
        F.lit(model).alias("model"),
        created_at.alias("created_at"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )
    return rows.select(*schemas.MATCH_SCORES.fieldNames())
