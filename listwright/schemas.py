"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, BOOL, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)
STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Arrival order of one sighting: pull, then feed, then file of the feed, then place in the file.
SEQ = _struct(batch_id=LONG, source_ord=INT, file=STR, pos=LONG)

RAW_LISTING = _struct(
    source=STR, source_ord=INT, file=STR, pos=LONG, feed_status=STR, payload=STR,
)

LISTING = _struct(
    source=STR, source_id=STR, company_name=STR, title=STR, url=STR, locations=STRINGS,
    season=STR, category=STR, degrees=STRINGS, sponsorship=STR, active=BOOL, posted_at=LONG,
    updated_at=LONG, company_url=STR, raw_payload=STR, seq=SEQ,
)

# Listings of a pull with their verdict and everything derived from them.
STAGED = T.StructType([
    *LISTING.fields,
    *_struct(
        feed_status=STR, verdict=STR, reason=STR, name_normalized=STR, fingerprint=STR, job_id=STR,
        company_id=STR, ats_provider=STR, ats_token=STR,
    ).fields,
])

COMPANIES = _struct(
    company_id=STR, name=STR, name_normalized=STR, ats_provider=STR, ats_token=STR,
    company_url=STR, created_at=TS, first_seq=SEQ, provider_seq=SEQ,
)

JOBS = _struct(
    job_id=STR, source=STR, source_id=STR, company_id=STR, fingerprint=STR, is_internship=BOOL,
    fetched_at=TS, title=STR, locations=STRINGS, url=STR, ats_provider=STR, ats_token=STR,
    season=STR, category=STR, degrees=STRINGS, sponsorship=STR, active=BOOL, posted_at=LONG,
    updated_at=LONG, raw_payload=STR, last_seen_at=TS, first_seq=SEQ, last_seq=SEQ,
)

MATCH_SCORES = _struct(
    job_id=STR, profile_version=STR, resume_version=STR, qualification_score=INT, fit_score=INT,
    class_year_eligible=BOOL, top_matches=STRINGS, top_gaps=STRINGS, fit_reasoning=STR,
    summary=STR, tier=STR, model=STR, created_at=TS, batch_id=LONG,
)

DEAD_SCORES = _struct(
    job_id=STR, profile_version=STR, resume_version=STR, response=STR, error=STR, batch_id=LONG,
)

TABLES = {
    "companies": COMPANIES,
    "jobs": JOBS,
    "match_scores": MATCH_SCORES,
    "dead_scores": DEAD_SCORES,
}
