"""Secret scans: candidates by form, a random forest that removes false positives.

A candidate is a run of 16 or more characters of `[A-Za-z0-9+/_-]` in a word, a digit among them;
every such run is one, so a word can hold several. It carries what the two words before its own
say, the run before it in its word, with the signs between, and what follows. The forest's features
are its length; transitions between
characters: changes of kind, kinds there are, and the share of digits and vowels; the part of its
trigrams that common words of the corpus have (dictionary coverage); whether its path, the
`source`, says test, example or documentation; and what the words beside it say.

The forest is trained on labelled findings: a bounded sample of candidates, the `sample_findings`
with the smallest hash. Findings of a provider's fixed form, or assigned to a name for a secret,
are labelled true; all-digit ones, those split by separators into words, and those whose letters
are all dictionary are labelled false. What neither says is unlabelled and left out of training.
Labelled findings of one's own can be given instead.

Defined cases: null and empty texts have no candidates; equal findings of repeated rows repeat;
null paths are no sign; with labels of one kind only, every candidate is kept. A finding gives its
place, the number of its run in the word (`piece`) and digest, not the secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.base import keyed, spaced_words, written

SAMPLE_FINDINGS = 20_000
TREES, DEPTH = 20, 6
#: A common word makes up this part of all words or more.
COMMON = 2e-6

#: What a value is made of, what it is not, and a run of the one with the other after it.
INSIDE, OUTSIDE = "[A-Za-z0-9+/_-]", "[^A-Za-z0-9+/_-]"
RUN = f"{INSIDE}+{OUTSIDE}*"
PROVIDERS = {
    "aws": r"^(AKIA|ASIA)[0-9A-Z]{16}$", "github": r"^gh[pousr]_[A-Za-z0-9]{36}$", "slack": r"^xox[abprs]-",
    "google": r"^AIza[0-9A-Za-z_-]{35}$", "stripe": r"^[sr]k_(live|test)_[0-9A-Za-z]{16,}$", "token": r"^eyJ[A-Za-z0-9_-]{10,}",
}
ASSIGNED = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|credential|private[_-]?key|auth)[\"']?\s*[:=]"
NAMED = r"(?i)pass(word|wd)?|secret|token|key|credential|auth|bearer"
PATH = r"(?i)test|example|sample|fixture|mock|doc"
FEATURES = [
    "length", "changes", "kinds", "digits", "vowels", "hexadecimal", "upper", "coverage", "in_path", "named", "assigned",
    "after_digits",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, mark, path, place of the word, what the words before say, number of the run in the
    word, the runs beside it and the value."""
    has_path = "source" in docs.columns
    path = F.col("source").cast("string") if has_path else F.lit(None).cast("string")
    words = keyed(docs, path.alias("path"), spaced_words(F.col("text")).alias("words")).filter("size(words) > 0")
    blank = F.array(F.lit(""))
    rows = words.select(
        "doc_id", "mark", "path", F.concat(blank, blank, "words").alias("b2"), F.concat(blank, "words").alias("b1"),
        F.col("words").alias("w"), F.slice("words", 2, F.size("words")).alias("a1"),
    ).select("doc_id", "mark", "path", F.posexplode(F.arrays_zip("b2", "b1", "w", "a1")).alias("place", "near"))
    rows = rows.select("doc_id", "mark", "path", "place", "near.*").filter("length(w) >= 16 and w rlike '[0-9]'")
    # Linear in the word, however long: no character is tried twice, and no run carries its word.
    said = F.concat_ws(" ", "b2", "b1", F.regexp_extract("w", f"^{OUTSIDE}*", 0))
    rows = rows.select(
        "doc_id", "mark", "path", "place", said.rlike(NAMED).alias("said_named"), said.rlike(ASSIGNED).alias("said_assigned"),
        F.regexp_extract_all("w", F.lit(RUN), F.lit(0)).alias("run"), F.substring("a1", 1, 1).alias("next"),
    )
    rows = rows.withColumns({
        "before": F.concat(blank, "run"), "after": F.concat(F.slice("run", 2, F.size("run")), F.array("next")),
    })
    about = ["doc_id", "mark", "path", "place", "said_named", "said_assigned"]
    rows = rows.select(*about, F.posexplode(F.arrays_zip("before", "run", "after")).alias("piece", "near"))
    rows = rows.select(*about, "piece", "near.before", "near.after", F.regexp_extract("near.run", f"^{INSIDE}+", 0).alias("value"))
    return rows.filter("length(value) >= 16 and value rlike '[0-9]'")


def common_trigrams(docs: DataFrame, common: float = COMMON) -> DataFrame:
    """Letter trigrams of words that make up `common` of all words or more; at most 26**3 rows.

    Runs of more than 40 letters are no words."""
    words = docs.select(F.explode(spaced_words(F.col("text"))).alias("word")).groupBy("word").count()
    words = written(words.withColumn("word", F.lower("word")).filter("word rlike '^[a-z]{3,40}$'"), "word-counts")
    total = words.agg(F.sum("count")).first()[0] or 0
    frequent = words.groupBy("word").agg(F.sum("count").alias("count")).filter(F.col("count") >= common * total)
    return trigrams(frequent, "word").select("trigram").distinct()


def trigrams(rows: DataFrame, column: str) -> DataFrame:
    """A row for each run of three characters, lower-cased."""
    split = rows.withColumn("letters", F.split(F.lower(F.col(column)), ""))
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("letters") - 3, F.lit(0))),
        lambda i: F.concat_ws("", F.get("letters", i), F.get("letters", i + 1), F.get("letters", i + 2)),
    )
    return split.withColumn("trigram", F.explode(each)).drop("letters")


def described(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The candidates with the features of the forest."""
    v = F.col("value")
    values = found.select("value").distinct()
    covered = trigrams(values, "value").join(F.broadcast(dictionary.withColumn("known", F.lit(1))), "trigram", "left")
    coverage = covered.groupBy("value").agg((F.count("known") / F.count(F.lit(1))).alias("share"))

    def count(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)).cast("double")

    pairs = ["(?<=[a-z])[0-9]", "(?<=[0-9])[a-z]", "(?<=[A-Z])[0-9]", "(?<=[0-9])[A-Z]", "(?<=[a-z])[A-Z]"]
    n = F.length(v).cast("double")
    kinds = sum((v.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")), F.lit(0.0))
    rows = found.join(coverage, "value", "left")
    return rows.select(
        *found.columns, n.alias("length"), (reduce(lambda a, b: a + b, map(count, pairs)) / n).alias("changes"),
        kinds.alias("kinds"), (count("[0-9]") / n).alias("digits"), (count("[aeiouAEIOU]") / n).alias("vowels"),
        v.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"), (count("[A-Z]") / n).alias("upper"),
        F.coalesce("share", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("path").rlike(PATH), F.lit(False)).cast("double").alias("in_path"),
        (F.col("said_named") | F.concat("before", "value").rlike(NAMED)).cast("double").alias("named"),
        (F.col("said_assigned") | F.col("before").rlike(ASSIGNED)).cast("double").alias("assigned"),
        F.coalesce(F.col("after").rlike("^[0-9]"), F.lit(False)).cast("double").alias("after_digits"),
    )


def provider() -> Column:
    return F.coalesce(*(F.when(F.col("value").rlike(form), F.lit(name)) for name, form in PROVIDERS.items()), F.lit("generic"))


def label() -> Column:
    """1 and 0 where the form of a finding says so, else null."""
    true = (provider() != "generic") | ((F.col("assigned") > 0) & (F.col("digits") > 0.1) & (F.col("kinds") >= 2) & (F.col("coverage") < 0.5))
    false = (F.col("digits") == 1) | (F.col("coverage") >= 0.8) | F.col("value").rlike("^[A-Za-z]+([-_/][A-Za-z0-9]+){2,}$")
    return F.when(true, 1.0).when(false, 0.0)


def scanned(docs: DataFrame, labelled: DataFrame | None = None, sample_findings: int = SAMPLE_FINDINGS) -> DataFrame:
    """doc_id, place, piece, detector, length, digest, probability and is_secret of every candidate.

    `labelled` has the features and `label`; by default it is made from the forms.
    """
    found = written(candidates(docs), "candidates")
    rows = written(described(found, common_trigrams(docs)), "described")
    if labelled is None:
        labelled = rows.withColumn("label", label()).filter("label is not null")
        labelled = labelled.orderBy(F.xxhash64("value", "doc_id", "place"), "doc_id", "place", "piece").limit(sample_findings)
    labelled = written(labelled.select(*FEATURES, F.col("label").cast("double").alias("label")), "labelled")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if labelled.select("label").distinct().count() < 2:
        judged = rows.withColumn("probability", F.lit(1.0))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42).fit(assembled.transform(labelled))
        judged = forest.transform(assembled.transform(rows).drop("probability")).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return judged.select(
        "doc_id", "place", "piece", provider().alias("detector"), F.length("value").alias("length"),
        F.sha2("value", 256).alias("digest"), F.round("probability", 6).alias("probability"),
        (F.col("probability") >= 0.5).alias("is_secret"),
    )
