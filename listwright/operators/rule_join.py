"""Tiering by a table of terms instead of one expression over all of them.

A text is cut into words and what separates them; a term matches where it equals some consecutive
words with their separators. So each text gives its distinct word n-grams, of as many words as a term
has, and those that the table has are kept. The plan does not depend on the number of terms. Terms are
broadcast while they are small, otherwise terms and n-grams both shuffle; n-grams, of which a small file
gives many, are never broadcast. Result as with `TierRules` of the same literal terms: any case, whole
words.

Terms begin and end with a letter, digit or underscore; others can only match between words and
are left out, as are null and empty ones. Repeated terms count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.fixed_values import TIER_KEYWORD, TIER_NAMED, TIER_SKIP

NAMED, SKIP, KEYWORD = "named", "skip", "keyword"
_WORD = r"[\p{L}\p{N}_]"
_RUNS = rf"{_WORD}+|(?:(?!{_WORD})(?s:.))+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0))


def rule_table(terms: DataFrame) -> DataFrame:
    """kind, term and its number of words, from rows with kind and term."""
    kept = terms.select("kind", F.lower("term").alias("term")).filter(
        F.col("term").rlike(rf"^{_WORD}(?s:.)*{_WORD}$|^{_WORD}$")
    )
    return kept.distinct().withColumn("words", F.floor((F.size(_runs(F.col("term"))) + 1) / 2).cast("int"))


def _grams(runs: Column, words: int) -> Column:
    """Texts of up to `words` consecutive words; runs alternate, so words are at every other place."""
    first = F.when(F.get(runs, F.lit(0)).rlike(rf"^{_WORD}"), 1).otherwise(2)
    starts = F.when(F.size(runs) >= first, F.sequence(first, F.size(runs), F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = F.flatten(F.transform(starts, lambda at: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(words - 1)), lambda n: at + 2 * n <= F.size(runs)),
        lambda n: F.array_join(F.slice(runs, at, 2 * n + 1), ""),
    )))
    return F.array_distinct(each)


def tier_by_table(rows: DataFrame, terms: DataFrame, id: str, company: str = "company_name", title: str = "title") -> DataFrame:
    """id and tier of every row: named companies first, then skipped titles, then keywords, then skip.

    `id` must tell rows apart."""
    rules = rule_table(terms)
    longest = rules.agg(F.max("words")).first()[0] or 0
    if not longest:
        return rows.select(id, F.lit(TIER_SKIP).alias("tier"))
    blob = F.concat(F.col(company), F.lit(" "), F.col(title))
    texts = rows.select(F.col(id).alias("_id"), F.explode(F.array(
        F.struct(F.lit(NAMED).alias("kind"), _runs(F.col(company)).alias("runs")),
        F.struct(F.lit(SKIP).alias("kind"), _runs(F.col(title)).alias("runs")),
        F.struct(F.lit(KEYWORD).alias("kind"), _runs(blob).alias("runs")),
    )).alias("text")).select("_id", "text.kind", "text.runs")
    grams = texts.select("_id", "kind", F.explode(_grams(F.col("runs"), longest)).alias("term"))
    rank = F.when(F.col("kind") == NAMED, 0).when(F.col("kind") == SKIP, 1).otherwise(2)
    # A semi join, as only its right side can be broadcast: the planner takes the n-grams to be as small as
    # the file that their texts come from.
    found = grams.join(rules.select("kind", "term"), ["kind", "term"], "left_semi").groupBy("_id").agg(F.min(rank).alias("_rank"))
    tier = F.when(F.col("_rank") == 0, TIER_NAMED).when(F.col("_rank") == 2, TIER_KEYWORD).otherwise(TIER_SKIP)
    return rows.select(id).join(found, F.col(id) == F.col("_id"), "left").select(id, tier.alias("tier"))
