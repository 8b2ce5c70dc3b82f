"""The two config documents a run is scored against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from listwright.functions.text import version_of_bytes


@dataclass(frozen=True)
class ConfigDocument:
    text: str
    version: str

    @classmethod
    def of(cls, content: bytes) -> ConfigDocument:
        return cls(content.decode("utf-8"), version_of_bytes(content))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConfigDocument:
        """Read one small document; any changed byte gives another version."""
        rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"expected one document at {path}")
        return cls.of(bytes(rows[0].content))
