"""Reports on whether the scorer uses its scale as it was told to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import CLUSTER_RANGE, FAMILY_TITLES, ROLE_RANGES, SCORE_BANDS
from listwright.functions.rules import any_pattern


def score_band(score: Column, bands: Sequence[tuple[int, str]] = SCORE_BANDS) -> Column:
    """Label of the band a score falls into; null below the lowest band."""
    label = F
    for lowest, name in bands:
        label = label.when(score >= lowest, F.lit(name))
    return label.otherwise(F.lit(None).cast("string"))


def role_rules(title: Column) -> list[tuple[str, Column, int, int]]:
    """Rules of `range_audit` for the known role families."""
    return [
        (family, title.rlike(any_pattern([FAMILY_TITLES[family]])), low, high)
        for family, low, high in ROLE_RANGES
    ]


def range_audit(
    scores: DataFrame, score: Column, rules: Sequence[tuple[str, Column, int, int]]
) -> DataFrame:
    """Per rule (family, condition, low, high): scores it covers, outside its range, above it.

    One pass with a pair of counters per rule; the rules are not joined to the scores.
    """
    counters = []
    for number, (_, applies, low, high) in enumerate(rules):
        counters += [
            F.count_if(applies).alias(f"covered_{number}"),
            F.count_if(applies & ~score.between(low, high)).alias(f"outside_{number}"),
            F.count_if(applies & (score > high)).alias(f"above_{number}"),
        ]
    per_rule = F.array(*(
        F.struct(
            F.lit(family).alias("family"),
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
            F.col(f"covered_{number}").alias("covered"),
            F.col(f"outside_{number}").alias("outside"),
            F.col(f"above_{number}").alias("above"),
        )
        for number, (family, _, low, high) in enumerate(rules)
    ))
    rows = scores.agg(*counters).select(F.inline(per_rule))
    share = F.when(F.col("covered") > 0, F.round(F.col("outside") / F.col("covered"), 6))
    return rows.withColumn("outside_share", share)


def axis_split(
    scores: DataFrame, qualification: str = "qualification_score", fit: str = "fit_score",
    low: int = 25, high: int = 75,
) -> DataFrame:
    """Whether the two axes move independently."""
    q, f = F.col(qualification), F.col(fit)
    return scores.agg(
        F.count("*").alias("n"),
        F.round(F.avg(q), 6).alias("mean_q"),
        F.round(F.avg(f), 6).alias("mean_fit"),
        F.round(F.stddev_samp(q), 6).alias("sd_q"),
        F.round(F.stddev_samp(f), 6).alias("sd_fit"),
        F.round(F.corr(q, f), 6).alias("correlation"),
        F.count_if((q <= low) & (f >= high)).alias("wanted_not_qualified"),
        F.count_if((q >= high) & (f <= low)).alias("qualified_not_wanted"),
    )


def cluster_share(
    scores: DataFrame, score: str = "qualification_score",
    bounds: tuple[int, int] = CLUSTER_RANGE,
) -> DataFrame:
    """Share of scores in the range where an undecided scorer ends up."""
    inside = F.count_if(F.col(score).between(*bounds))
    return scores.agg(
        F.count("*").alias("n"),
        inside.alias("clustered"),
        F.when(F.count("*") > 0, F.round(inside / F.count("*"), 6)).alias("share"),
    )
