"""Joining values with a table of ranges, and the audit of scores by such a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def range_join(rows: DataFrame, value: str, ranges: DataFrame, width: float, low: str = "low", high: str = "high") -> DataFrame:
    """Every row with every range that holds its value, both ends included.

    Values and ranges meet by bucket, `width` wide: a value is in one, a range in each that it
    touches. So the join is on equality, with as many copies of a range as its length has widths;
    choose the width near the length of most ranges. Null values, ends and empty ranges meet nothing.
    """
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    )))
    placed = rows.withColumn("_bucket", F.floor(F.col(value) / width))
    joined = placed.join(cut, "_bucket").drop("_bucket")
    return joined.filter((joined[value] >= joined[low]) & (joined[value] <= joined[high]))


def range_rule_audit(scores: DataFrame, score: str, family: str, rules: DataFrame, width: float = 10) -> DataFrame:
    """Per rule (family, low, high): scores of the family, outside its range and above it, and of any family within.

    Scores are counted by family and value first, so what meets the rules is as small as their domain.
    """
    counts = scores.groupBy(F.col(family).alias("_family"), F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    held = range_join(counts.select("_score", "_n"), "_score", rules, width).groupBy("family", "low", "high").agg(
        F.sum("_n").alias("within")
    )
    own = rules.join(counts, rules["family"] == counts["_family"], "left").groupBy("family", "low", "high")
    n = F.coalesce(F.col("_n"), F.lit(0))
    outside = ~F.col("_score").between(F.col("low"), F.col("high"))
    judged = own.agg(
        F.sum(n).alias("covered"), F.sum(F.when(outside, n).otherwise(0)).alias("outside"),
        F.sum(F.when(F.col("_score") > F.col("high"), n).otherwise(0)).alias("above"),
    )
    share = F.when(F.col("covered") > 0, F.round(F.col("outside") / F.col("covered"), 6))
    return judged.join(held, ["family", "low", "high"], "left").select(
        "family", "low", "high", "covered", "outside", "above", share.alias("outside_share"),
        F.coalesce("within", F.lit(0)).alias("within"),
    )
