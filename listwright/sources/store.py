"""Versioned Parquet tables with atomic commits.

Every write goes to a directory of its own; nothing that may be read is overwritten. A commit is one
small directory of the commit log, made for its version: it names, for each table, the directories that make
up its content. Readers take the newest commit, so a run that dies half way leaves nothing visible.

Merged tables are kept as a base plus the folds of later batches. A batch therefore writes only its
own keys, not the whole table. Readers fold the directories together. A commit writes its batch and
the directories that are not clearly larger as one, so their number and how often a row is written
again grow with the logarithm of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from listwright import schemas
from listwright.operators import merge

COMMIT_SCHEMA = "version bigint, token string, content string, stream string, stream_batch bigint"

# fold(rows, columns): rows of one key in several directories become one row.
Fold = Callable[..., DataFrame]



@dataclass(frozen=True)
class Merged:
    """How a merged table folds, and the one column that identifies its rows."""

    key: str
    fold: Fold


# Append-only tables are not listed.
MERGED = {
    "jobs": Merged("job_id", merge.fold_jobs),
    "companies": Merged("company_id", merge.fold_companies),
}

class Part(NamedTuple):
    """A written directory and its number of rows."""

    path: str
    rows: int


@dataclass(frozen=True)
class Commit:
    version: int = 0
    content: dict[str, list[Part]] = field(default_factory=dict)

    def parts(self, table: str) -> list[Part]:
        return [Part(*part) for part in self.content.get(table, [])]


class ConcurrentCommitError(RuntimeError):
    """Another writer has committed the version."""


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Store:
    def __init__(
        self, spark: SparkSession, root: str, tables: dict[str, T.StructType] | None = None,
        merged: dict[str, Merged] | None = None, merge_factor: int = 2,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = dict(schemas.TABLES if tables is None else tables)
        self.merged = dict(MERGED if merged is None else merged)
        self.merge_factor = merge_factor

    # --- commit log ------------------------------------------------------------------------------

    def _log(self) -> DataFrame | None:
        path = f"{self.root}/commits"
        if not path_exists(self.spark, path):
            return None
        return self.spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", True).parquet(path)

    def current(self) -> Commit:
        """The newest commit; an empty one when nothing was ever committed."""
        log = self._log()
        if log is None:
            return Commit()
        newest = log.orderBy(F.desc("version"), "token").limit(1).collect()
        if not newest:
            return Commit()
        return Commit(newest[0].version, json.loads(newest[0].content))

    def commit(
        self, base: Commit, changes: dict[str, list[Part]], stream: str | None = None,
        stream_batch: int | None = None,
    ) -> Commit:
        """Publish new directory lists for some tables on top of `base`.

        Raises `ConcurrentCommitError` if another writer has published that version. Two that
        wrote it in the same moment both leave a row: the smaller token counts, for the writers as
        for all readers.
        """
        following = Commit(base.version + 1, {**base.content, **changes})
        token = uuid.uuid4().hex
        row = [(following.version, token, json.dumps(following.content), stream, stream_batch)]
        path = f"{self.root}/commits/{following.version:012d}"
        try:
            self.spark.createDataFrame(row, COMMIT_SCHEMA).coalesce(1).write.mode("error").parquet(path)
        except AnalysisException as taken:
            raise ConcurrentCommitError(f"version {following.version} is committed") from taken
        first = self.spark.read.schema(COMMIT_SCHEMA).parquet(path).agg(F.min("token")).first()[0]
        if first != token:
            raise ConcurrentCommitError(f"version {following.version} is committed")
        return following

    def last_stream_batch(self, stream: str) -> int:
        """Highest micro-batch of a stream that was committed, or -1."""
        log = self._log()
        if log is None:
            return -1
        last = log.filter(F.col("stream") == stream).agg(F.max("stream_batch")).first()[0]
        return -1 if last is None else last

    # --- reading ---------------------------------------------------------------------------------

    def _load(self, table: str, parts: Iterable[Part]) -> DataFrame:
        schema = self.tables[table]
        paths = [self.path(part) for part in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.root}/{table}").parquet(*paths)
            .select(*schema.fieldNames())
        )

    def read(
        self, table: str, commit: Commit | None = None, columns: Sequence[str] | None = None
    ) -> DataFrame:
        """Table content at a commit, with its declared schema; empty if never written."""
        parts = (commit or self.current()).parts(table)
        wanted = list(columns or self.tables[table].fieldNames())
        how = self.merged.get(table)
        if how is None or len(parts) < 2:  # one directory is a fold already
            return self._load(table, parts).select(*wanted)
        return how.fold(self._load(table, parts), columns).select(*wanted)

    def read_unfolded(self, table: str, commit: Commit) -> DataFrame:
        """All rows of all parts: a key may occur once per part."""
        return self._load(table, commit.parts(table))

    def read_part(self, part: Part, schema: T.StructType | str) -> DataFrame:
        """One directory, also when it holds no rows and so no files."""
        return self.spark.read.schema(schema).parquet(self.path(part))

    def read_parts(self, parts: Sequence[Part], schema: T.StructType | str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, (self.read_part(part, schema) for part in parts))

    # --- writing ---------------------------------------------------------------------------------

    def path(self, part: Part) -> str:
        return f"{self.root}/{part.path}"

    def write_part(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> Part:
        """Write rows to a new directory; nothing refers to it until it is committed."""
        path = f"{table}/part={uuid.uuid4().hex}"
        counted = Observation()
        writer = rows.observe(counted, F.count(F.lit(1)).alias("rows")).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.mode("errorifexists").parquet(f"{self.root}/{path}")
        return Part(path, counted.get["rows"])

    def write_fold(self, table: str, batch: DataFrame, base: Commit) -> list[Part]:
        """Write the fold of a batch; returns the directories the table then has.

        Directories with fewer than `merge_factor` times the rows of all later ones are merged with
        these, so each that stays is that much larger than the next.
        """
        fold, older = self.merged[table].fold, list(base.parts(table))
        newer = [self.write_part(table, fold(batch))]
        if older and not newer[0].rows:
            return older
        while older and older[-1].rows < self.merge_factor * sum(part.rows for part in newer):
            newer.insert(0, older.pop())
        if len(newer) > 1:
            newer = [self.write_part(table, fold(self._load(table, newer)))]
        return [*older, *newer]

    def initialize(self) -> Commit:
        """Commit the empty store if there is none yet; otherwise change nothing."""
        now = self.current()
        return now if now.version else self.commit(now, {})
