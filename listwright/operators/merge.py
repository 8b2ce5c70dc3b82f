"""Order-explicit keyed merge.

State is one row per key. Columns frozen at the first sighting come from the row with the smallest
sequence, mutable columns from the row with the largest. Both are plain ``min_by`` / ``max_by``
aggregates, so

* folding state with a batch is the same operation as folding the batch itself,
* the fold is associative over ordered batches, and does not depend on partitioning,
* a key that holds a large share of all rows is reduced to one row per task before the exchange.

Wide mutable columns can be named `late`: they stay out of the aggregate, which then sorts and ships
narrow rows only, and are fetched afterwards by key and last sequence. That join is dealt by both, so
the rows of a hot key spread over all tasks. It needs what arrival order gives anyway: a key has no
two rows with one sequence.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from listwright import schemas


@dataclass(frozen=True)
class MergeSpec:
    keys: tuple[str, ...]
    frozen: tuple[str, ...]
    mutable: tuple[str, ...]
    late: tuple[str, ...] = ()

    def only(self, columns: Iterable[str] | None) -> MergeSpec:
        """The same merge carrying fewer columns, so a reader does not fold what it drops."""
        if columns is None:
            return self
        wanted = set(columns)
        return MergeSpec(
            self.keys,
            tuple(c for c in self.frozen if c in wanted),
            tuple(c for c in self.mutable if c in wanted),
            tuple(c for c in self.late if c in wanted),
        )


JOBS_MERGE = MergeSpec(
    keys=("job_id", "source", "source_id"),
    frozen=("company_id", "fingerprint", "is_internship", "fetched_at"),
    mutable=(
        "title", "locations", "url", "ats_provider", "ats_token", "season", "category", "degrees",
        "sponsorship", "active", "posted_at", "updated_at", "raw_payload", "last_seen_at",
    ),
    late=("raw_payload",),
)


def sightings(rows: DataFrame, spec: MergeSpec, seq: Column) -> DataFrame:
    """Rows in state shape: a single sighting is both the first and the last."""
    return rows.select(
        *spec.keys, *spec.frozen, *spec.mutable,
        seq.alias("first_seq"), seq.alias("last_seq"),
    )


def fold(rows: DataFrame, spec: MergeSpec) -> DataFrame:
    """Fold rows in state shape (state, sightings or both) to one row per key."""
    return _with_late(_folded(rows, spec), rows, spec)


def _folded(rows: DataFrame, spec: MergeSpec, *more: Column) -> DataFrame:
    """The fold without its late columns, and more aggregates."""
    early = [c for c in spec.mutable if c not in spec.late]
    aggregates = [F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), *more]
    if spec.frozen:
        aggregates.append(F.min_by(F.struct(*spec.frozen), "first_seq").alias("_frozen"))
    if early:
        aggregates.append(F.max_by(F.struct(*early), "last_seq").alias("_mutable"))
    folded = rows.groupBy(*spec.keys).agg(*aggregates)
    return folded.select(
        *spec.keys,
        *(F.col(f"_frozen.{c}").alias(c) for c in spec.frozen),
        *(F.col(f"_mutable.{c}").alias(c) for c in early),
        *(c for c in folded.columns if c not in (*spec.keys, "_frozen", "_mutable")),
    )


def _with_late(folded: DataFrame, rows: DataFrame, spec: MergeSpec) -> DataFrame:
    """Late columns from the row of each key that was seen last."""
    more = [c for c in folded.columns if c not in (*spec.keys, *spec.frozen, *spec.mutable, "first_seq", "last_seq")]
    if spec.late:
        wide = rows.select(
            *(F.col(c).alias(f"_{c}") for c in (*spec.keys, "last_seq")), *spec.late
        )
        same = reduce(and_, (folded[c].eqNullSafe(wide[f"_{c}"]) for c in (*spec.keys, "last_seq")))
        folded = folded.join(wide, same)
    return folded.select(*spec.keys, *spec.frozen, *spec.mutable, "first_seq", "last_seq", *more)


def upsert(state: DataFrame, batch: DataFrame, spec: MergeSpec) -> DataFrame:
    """New state after a batch, both in state shape."""
    return fold(state.unionByName(batch), spec)


def job_sightings(listings: DataFrame, run_at: Column) -> DataFrame:
    """Enriched listings in the state shape of the jobs table."""
    rows = listings.select(
        "*",
        F.lit(True).alias("is_internship"),
        run_at.alias("fetched_at"),
        run_at.alias("last_seen_at"),
    )
    return sightings(rows, JOBS_MERGE, F.col("seq"))


def company_sightings(listings: DataFrame, run_at: Column) -> DataFrame:
    """Enriched listings in the state shape of the companies table."""
    return listings.select(
        "company_id",
        F.col("company_name").alias("name"),
        "name_normalized", "ats_provider", "ats_token", "company_url",
        run_at.alias("created_at"),
        F.col("seq").alias("first_seq"),
        F.when(F.coalesce(F.col("ats_provider"), F.lit("")) != "", F.col("seq"))
        .alias("provider_seq"),
    )


def fold_jobs(rows: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return fold(rows, JOBS_MERGE.only(columns))


def fold_companies(rows: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per company key: the first spelling and URL, and the first known provider.

    Provider and token come together from the first sighting that has a provider; once set they
    never change. A company URL that was missing at the first sighting stays missing.
    """
    folded = rows.groupBy("company_id", "name_normalized").agg(
        F.min_by(F.struct("name", "company_url", "created_at"), "first_seq").alias("_first"),
        F.min_by(F.struct("ats_provider", "ats_token"), "provider_seq").alias("_ats"),
        F.min("first_seq").alias("first_seq"),
        F.min("provider_seq").alias("provider_seq"),
    )
    return folded.select(
        "company_id",
        F.col("_first.name").alias("name"),
        "name_normalized",
        F.col("_ats.ats_provider").alias("ats_provider"),
        F.col("_ats.ats_token").alias("ats_token"),
        F.col("_first.company_url").alias("company_url"),
        F.col("_first.created_at").alias("created_at"),
        "first_seq", "provider_seq",
    ).select(*(columns or schemas.COMPANIES.fieldNames()))


def upsert_counted(state: DataFrame, batch: DataFrame, spec: MergeSpec) -> tuple[DataFrame, Observation]:
    """New state after a batch; writing it also counts total_seen, inserted and updated.

    A marker tells rows of the state from those of the batch, so the fold's own pass knows for each
    key how often the batch has it and whether the state had it. Nothing is read a second time.
    """
    marked = state.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    folded = _folded(marked, spec, F.sum("_new").alias("_seen"), F.min("_new").alias("_unknown"))
    counted, zero = Observation(), F.lit(0).cast("bigint")
    seen = F.coalesce(F.sum("_seen"), zero)
    inserted = F.count_if(F.col("_unknown") == 1)
    observed = folded.observe(
        counted, seen.alias("total_seen"), inserted.alias("inserted"), (seen - inserted).alias("updated")
    ).drop("_seen", "_unknown")
    return _with_late(observed, marked, spec), counted


def merge_stats(state: DataFrame, batch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """total_seen, inserted, updated of a batch of sightings against the state before it.

    Every sighting after a key's first one is an update, whether or not it changed anything. Keys of
    both, with a marker, are counted in one pass; no other column is read.
    """
    marked = state.select(*keys, F.lit(0).alias("_new")).unionByName(batch.select(*keys, F.lit(1).alias("_new")))
    per_key = marked.groupBy(*keys).agg(F.sum("_new").alias("_seen"), F.min("_new").alias("_unknown"))
    seen = F.coalesce(F.sum("_seen"), F.lit(0).cast("bigint"))
    inserted = F.count_if(F.col("_unknown") == 1)
    return per_key.agg(seen.alias("total_seen"), inserted.alias("inserted"), (seen - inserted).alias("updated"))
