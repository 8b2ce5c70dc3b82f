"""Toxicity as ordinal regression with cumulative links, trained on labelled documents.

Severity has grades 0 to 3. P(grade > k) = sigmoid(w.x - t_k): weights are shared by all
thresholds, which are kept in order. x says which of the chosen features a text has: its words
(runs of letters, lower-cased) and their first four, five and six letters, so that a stem is known
in words never seen. Features are chosen by their document counts in the two classes. The labels
are yes or no; the grade of a toxic document is taken from how many of its distinct words hold a
chosen feature: one is grade 1, two or three grade 2, more grade 3, and grade 1 if none does.

A bounded sample is fitted: per class, the `per_class` labelled documents with the smallest hash
of their id; equal texts count once. Counting is spread over the executors; the driver gets the chosen features of the
sample, at most `max_features` of them, and the lists of their numbers.

Defined cases: null, empty and wordless texts have no features and get the grade of the
thresholds alone, unless there is no label of a class; then the model rejects nothing. Null
labels and labels without a document are left out; a document labelled both ways is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

GRADES = 4
PER_CLASS = 10_000
MAX_FEATURES = 8192
#: A feature is chosen if it is so many times as common in toxic documents, and the likelihood ratio
#: of its counts (natural logarithm) leaves no room for chance among all rare words.
LEAST_RATIO = 4.0
LEAST_GAIN = 20.0
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def active(self, text: str | None) -> tuple[set[int], int]:
        """Numbers of the features of a text, and how many of its distinct words hold one."""
        found, holding = set(), 0
        known = self.features
        for word in distinct_words(text):
            own = [known[f] for f in word_features(word) if f in known]
            holding += bool(own)
            found.update(own)
        return found, holding

    def exceeds(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        found, _ = self.active(text)
        return _sigmoid(self.weights[list(found)].sum() - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic (0 or 1) and grade of the sampled documents; the grade is null where labels have none."""
    own_grade = F.col("grade").cast("int") if "grade" in labels.columns else F.lit(None).cast("int")
    toxic = F.when(own_grade.isNotNull(), (own_grade > 0).cast("int")).otherwise(F.col("toxic").cast("int"))
    judged = labels.select("doc_id", toxic.alias("toxic"), own_grade.alias("grade"))
    by_id = judged.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max("grade").alias("grade")
    )
    chosen = None
    for value in (0, 1):
        own = by_id.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"), F.col("grade").alias("_grade"))
    # at most 2 * per_class rows of three numbers
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select(
        "text", F.col("_toxic").alias("toxic"), F.col("_grade").alias("grade")
    ).dropDuplicates()


def _class_counts(batches):
    counts = (Counter(), Counter())
    for part in batches:
        for text, toxic in zip(part["text"], part["toxic"]):
            own = {f for word in distinct_words(text) for f in word_features(word)}
            counts[toxic > 0].update(own)
    if counts[1] or counts[0]:
        names = list(counts[1].keys() | counts[0].keys())
        yield pd.DataFrame({
            "feature": names, "toxic": [counts[1][n] for n in names], "clean": [counts[0][n] for n in names],
        })


def chosen_features(sample: DataFrame, max_features: int = MAX_FEATURES) -> list[str]:
    totals = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return []
    counts = sample.mapInPandas(_class_counts, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    ratio = ((F.col("toxic") + 0.5) / (totals[True] + 1)) / ((F.col("clean") + 0.5) / (totals[False] + 1))
    share = totals[True] / (totals[True] + totals[False])
    n = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))
    ).otherwise(0.0)
    rows = counts.filter((F.col("toxic") > 0) & (ratio >= LEAST_RATIO) & (gain >= LEAST_GAIN)).orderBy(
        gain.desc(), "feature"
    ).limit(max_features).collect()
    return [r["feature"] for r in rows]


def _grade(toxic: int, holding: int) -> int:
    return 0 if not toxic else 1 if holding < 2 else 2 if holding < 4 else 3


def fit_ordinal(rows: list[tuple[tuple[int, ...], int, int]], n_features: int, steps: int = 800,
                penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for (features, grade, count) rows, by Adam on all rows.

    Rows with and without severity weigh the same in all."""
    counts = np.array([r[2] for r in rows], float)
    grades = np.array([r[1] for r in rows])
    for side in (grades == 0, grades > 0):
        counts[side] /= max(counts[side].sum(), 1)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    feature = np.array([f for r in rows for f in r[0]], int)
    k = GRADES - 1
    above = (grades[:, None] > np.arange(k)).astype(float)
    # thresholds are t_0, t_0 + exp(g_1), ...
    value = np.concatenate((np.zeros(n_features), [2.0], np.zeros(k - 1)))
    first, second = np.zeros_like(value), np.zeros_like(value)
    total = counts.sum()

    def thresholds(v):
        return v[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(v[n_features + 1:]))))

    for step in range(1, steps + 1):
        score = np.bincount(owner, value[feature], len(rows)) if len(feature) else np.zeros(len(rows))
        t = thresholds(value)
        upper = np.column_stack((np.ones(len(rows)), _sigmoid(score[:, None] - t)))  # P(grade > k-1)
        lower = np.column_stack((upper[:, 1:], np.zeros(len(rows))))
        at = np.arange(len(rows))
        p = np.maximum(upper[at, grades] - lower[at, grades], 1e-9)
        slope_up = upper[at, grades] * (1 - upper[at, grades]) * (grades > 0)
        slope_low = lower[at, grades] * (1 - lower[at, grades])
        by_score = -(slope_up - slope_low) / p * counts / total
        by_t = np.zeros(k)
        np.add.at(by_t, np.maximum(grades - 1, 0), (slope_up / p * counts / total) * (grades > 0))
        inner = grades < k
        np.add.at(by_t, grades[inner], (-slope_low / p * counts / total)[inner])
        gradient = np.zeros_like(value)
        if len(feature):
            gradient[:n_features] = np.bincount(feature, by_score[owner], n_features)
        gradient[:n_features] += penalty * value[:n_features]
        gradient[n_features] = by_t.sum()
        gradient[n_features + 1:] = np.exp(value[n_features + 1:]) * np.cumsum(by_t[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        value = value - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return value[:n_features], thresholds(value)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
          max_features: int = MAX_FEATURES) -> Model:
    """The model, fitted on the sampled documents. Labels that have a `grade` (0 is clean) give the grades
    to learn; for the others, whose `toxic` says only yes or no, grades are made from the text."""
    sample = labelled_sample(docs, labels, per_class)
    names = chosen_features(sample, max_features)
    nothing = Model({}, np.zeros(0), np.full(GRADES - 1, 20.0))
    if not names:
        return nothing
    model = Model({n: i for i, n in enumerate(names)}, np.zeros(len(names)), nothing.thresholds)

    def rows(batches):
        for part in batches:
            found = [model.active(t) for t in part["text"]]
            yield pd.DataFrame({
                "features": [sorted(f) for f, _ in found],
                "grade": [
                    _grade(t, n) if pd.isna(own) else min(max(int(own), 0), GRADES - 1)
                    for t, own, (_, n) in zip(part["toxic"], part["grade"], found)
                ],
            })

    grouped = sample.mapInPandas(rows, "features array<int>, grade int").groupBy("features", "grade").count()
    table = sorted((tuple(r["features"]), r["grade"], r["count"]) for r in grouped.collect())
    model.weights, model.thresholds = fit_ordinal(table, len(names))
    return model


def graded(text: Column, model: Model) -> Column:
    """severity (the expected grade), grade (the median one) and toxic (P(grade > 0) of one half or more)."""

    @F.pandas_udf("severity double, grade int, toxic boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        p = np.array([model.exceeds(t) for t in texts]).reshape(len(texts), GRADES - 1)
        return pd.DataFrame({
            "severity": p.sum(axis=1).round(6), "grade": (p >= 0.5).sum(axis=1).astype("int32"), "toxic": p[:, 0] >= 0.5,
        })

    return of(text)
