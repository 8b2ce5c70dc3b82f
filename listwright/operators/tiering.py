"""Tier assignment over listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright.fixed_values import TIER_PRESETS
from listwright.functions.rules import TierRules

DEFAULT_RULES = TierRules()


def with_tier(
    rows: DataFrame, rules: TierRules = DEFAULT_RULES, company: str = "company_name",
    title: str = "title",
) -> DataFrame:
    return rows.withColumn("tier", rules.tier(F.col(company), F.col(title)))


def in_tiers(rows: DataFrame, preset: str | tuple[str, ...] = "tier1") -> DataFrame:
    """Rows of the chosen tiers; a preset name or the tiers themselves."""
    tiers = TIER_PRESETS[preset] if isinstance(preset, str) else preset
    return rows.filter(F.col("tier").isin(*tiers))


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier").agg(F.count("*").alias("n"))


def with_matched_terms(
    rows: DataFrame, rules: TierRules = DEFAULT_RULES, company: str = "company_name",
    title: str = "title",
) -> DataFrame:
    return rows.withColumn("matched_terms", rules.matched_terms(F.col(company), F.col(title)))
