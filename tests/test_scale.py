import random
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from listwright.catalog import scale
from listwright.functions.rules import TierRules
from listwright.operators import merge, queue, review
from listwright.operators.heavy import most_common_bounded
from listwright.operators.normalize import most_common
from listwright.operators.ranges import range_join, range_rule_audit
from listwright.operators.rule_join import rule_table, tier_by_table
from listwright.operators.tiering import with_tier
from listwright.sources.bucketed import buckets_for, write_bucketed
from listwright.streaming.sliced import first_slice_of, fold_stream, folded_state, land_in_slices, read_slices
from listwright.streaming.stateless import stream_dedup

SPEC = merge.MergeSpec(keys=("k", "s"), frozen=("born",), mutable=("value", "payload"), late=("payload",))
WHOLE = merge.MergeSpec(keys=("k", "s"), frozen=("born",), mutable=("value", "payload"))


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def sightings(spark, n=300, start=0):
    rng = random.Random(n + start)
    # One key, with a null part, holds half of all rows.
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.choice([None, "s"]), f"b{i}", i % 7,
             None if i % 11 == 0 else "p" * (i % 50), start + i) for i in range(n)]
    frame = spark.createDataFrame(data, "k string, s string, born string, value int, payload string, seq int")
    return merge.sightings(frame, SPEC, F.col("seq"))


def rows(frame):
    return sorted(map(str, frame.collect()))


# --- merge -------------------------------------------------------------------------------------------


def test_late_columns_give_the_same_rows(spark):
    frame = sightings(spark)
    found = merge.fold(frame, SPEC)
    assert found.columns == merge.fold(frame, WHOLE).columns == frame.columns
    assert rows(found) == rows(merge.fold(frame, WHOLE))
    state = merge.fold(frame.filter("last_seq < 120"), SPEC)
    assert rows(merge.upsert(state, frame.filter("last_seq >= 120"), SPEC)) == rows(found)
    struct_seq = frame.withColumn("first_seq", F.struct(F.lit(None).cast("string").alias("f"), "first_seq")).withColumn(
        "last_seq", F.struct(F.lit(None).cast("string").alias("f"), "last_seq"))
    assert merge.fold(struct_seq, SPEC).count() == found.count()


def test_late_columns_stay_out_of_the_aggregate(spark):
    plan = merge.fold(sightings(spark), SPEC)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "payload" not in aggregate and "value" in aggregate
    narrow = merge.fold(sightings(spark), SPEC.only(("k", "value")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in narrow


def test_counts_are_made_while_the_state_is_written(spark, tmp_path):
    state = merge.fold(sightings(spark, 100), SPEC)
    batch = sightings(spark, 200, 100).withColumn("k", F.when(F.col("last_seq") % 5 == 0, F.concat(F.lit("new"), "last_seq")).otherwise(F.col("k")))
    found, counted = merge.upsert_counted(state, batch, SPEC)
    found.write.parquet(str(tmp_path / "state"))
    written = spark.read.parquet(str(tmp_path / "state"))
    assert rows(written.select(*state.columns)) == rows(merge.upsert(state, batch, SPEC))
    known = {(r.k, r.s) for r in state.select("k", "s").collect()}
    seen = Counter((r.k, r.s) for r in batch.select("k", "s").collect())
    inserted = sum(key not in known for key in seen)
    assert counted.get == {"total_seen": 200, "inserted": inserted, "updated": 200 - inserted}
    assert merge.merge_stats(state, batch, ("k", "s")).first().asDict() == counted.get
    empty = merge.merge_stats(state.limit(0), batch.limit(0), ("k", "s")).first()
    assert tuple(empty) == (0, 0, 0)
    assert "Join" not in physical(merge.merge_stats(batch, batch, ("k", "s")))


# --- values, rules, ranges ---------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_bounded_counts_are_exact(spark, buckets):
    rng = random.Random(buckets)
    values = [rng.choice([None, "hot"]) if rng.random() < 0.3 else f"v{min(int(rng.expovariate(0.02)), 400)}" for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(values)), "seq int, v string").repartition(5)
    for k in (1, 5, 40, 1000):
        found = most_common_bounded(frame, "v", F.col("seq"), k, buckets).collect()
        assert list(map(tuple, found)) == list(map(tuple, most_common(frame, "v", F.col("seq"), k).collect()))
    assert most_common_bounded(frame.limit(0), "v", F.col("seq"), 3, buckets).collect() == []


TERMS = [("named", "Acme"), ("named", "big co"), ("named", "x#1"), ("skip", "senior"), ("skip", "sales lead"),
         ("keyword", "machine learning"), ("keyword", "ops"), ("keyword", "été"), ("keyword", "a b c d"), ("named", None),
         ("skip", ""), ("keyword", "OPS")]


def test_term_tables_tier_as_expressions_do(spark):
    rng = random.Random(5)
    words = ["Acme", "acme's", "Acmes", "big", "co", "x#1", "x #1", "Senior", "SALES", "lead", "machine", "learning", "machine-learning",
             "ops", "devops", "Été", "a", "b", "c", "d", "_ops", "", "  ", "\n", "ops."]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(400)]
    frame = spark.createDataFrame(data, "id int, company_name string, title string")
    terms = spark.createDataFrame(TERMS, "kind string, term string")

    def of(kind):
        return tuple(dict.fromkeys(t.lower() for k, t in TERMS if k == kind and t))

    rules = TierRules(of("named"), tuple(rf"\b{t}\b" for t in of("keyword")), tuple(rf"\b{t}\b" for t in of("skip")))
    expected = {r.id: r.tier for r in with_tier(frame, rules).collect()}
    found = {r.id: r.tier for r in tier_by_table(frame, terms, "id").collect()}
    assert found == expected and set(expected.values()) == {"named_target", "keyword", "skip"}
    none = tier_by_table(frame, terms.limit(0), "id")
    assert {r.tier for r in none.collect()} == {"skip"} and none.count() == 400


def test_the_plan_does_not_grow_with_the_terms(spark):
    frame = spark.createDataFrame([(1, "c", "t")], "id int, company_name string, title string")
    sizes = []
    for n in (10, 20000):
        terms = spark.range(n).select(F.lit("named").alias("kind"), F.concat(F.lit("term "), F.col("id")).alias("term"))
        sizes.append(len(physical(tier_by_table(frame, terms, "id"))))
    assert abs(sizes[1] - sizes[0]) < 200
    assert [tuple(r) for r in rule_table(spark.createDataFrame([("named", "C++"), ("named", "a-b c")], "kind string, term string")).collect()] == [
        ("named", "a-b c", 3)]


def test_ngrams_of_a_small_file_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id") % 400).alias("id"), F.concat(F.lit("Acme "), F.col("id") % 7).alias("company_name"),
                            F.lit("Sales Lead").alias("title")).write.parquet(path)
    terms = spark.createDataFrame([("named", "acme 3"), ("skip", "sales lead"), ("skip", "Sales Lead"), ("keyword", "lead")], "kind string, term string")
    found = tier_by_table(spark.read.parquet(path), terms, "id")
    assert "BuildLeft" not in physical(found) and "LeftSemi" in physical(found)
    listed = found.collect()
    named = {i % 400 for i in range(500) if i % 50 and i % 7 == 3}
    assert len(listed) == 500 and sum(r.id is None for r in listed) == 10
    assert all(r.tier == ("named_target" if r.id in named else "skip") for r in listed)


def test_range_join_finds_every_range_of_every_value(spark):
    rng = random.Random(8)
    values = [rng.choice([None, rng.randint(-50, 150), 30]) for _ in range(200)]
    ranges = [(f"r{i}", rng.randint(-60, 150), rng.randint(-60, 200)) for i in range(25)] + [("null", None, 5)]
    found = range_join(spark.createDataFrame(list(enumerate(values)), "i int, v int"), "v",
                       spark.createDataFrame(ranges, "name string, low int, high int"), 10)
    expected = sorted((i, n) for i, v in enumerate(values) for n, low, high in ranges if None not in (v, low) and low <= v <= high)
    assert sorted((r.i, r.name) for r in found.collect()) == expected
    assert "NestedLoop" not in physical(found) and "Cartesian" not in physical(found)


def test_range_rules_keep_families_without_scores(spark):
    scores = spark.createDataFrame([(5, "a"), (15, "a"), (25, "a"), (None, "a"), (12, "b"), (99, None)], "q int, f string")
    rules = spark.createDataFrame([("a", 10, 20), ("b", 10, 20), ("c", 0, 100)], "family string, low int, high int")
    found = {r.family: (r.covered, r.outside, r.above, r.outside_share, r.within) for r in range_rule_audit(scores, "q", "f", rules).collect()}
    assert found == {"a": (4, 2, 1, 0.5, 2), "b": (1, 0, 0, 0.0, 2), "c": (0, 0, 0, None, 5)}


# --- bucketed tables ---------------------------------------------------------------------------------


def test_bucketed_tables_join_without_moving_scores(spark, tmp_path):
    jobs = spark.range(50).select(F.col("id").alias("job_id"), (F.col("id") % 5).alias("company_id"), F.lit("t").alias("title"),
                                  F.array(F.lit("x")).alias("locations"), F.lit("u").alias("url"))
    scores = spark.range(300).select((F.col("id") % 60).alias("job_id"), F.lit("p").alias("profile_version"), F.lit("r").alias("resume_version"),
                                     F.lit(1).alias("qualification_score"), F.lit(2).alias("fit_score"), F.lit("s").alias("summary"),
                                     F.lit("t").alias("tier"), F.lit(0).alias("created_at"))
    companies = spark.range(5).select(F.col("id").alias("company_id"), F.lit("n").alias("name"), F.lit("g").alias("ats_provider"))
    b_jobs = write_bucketed(jobs, "jobs", "job_id", 4, str(tmp_path / "jobs"))
    b_scores = write_bucketed(scores, "scores", "job_id", 4, str(tmp_path / "scores"))
    joined = review.bucketed_view(b_scores, b_jobs, companies)
    assert "Exchange hashpartitioning" not in physical(joined) and "SortMergeJoin" in physical(joined)
    assert joined.count() == review.score_view(scores, jobs, companies).count() == 250
    left = queue.unscored(b_jobs, b_scores.filter("job_id % 2 = 0").hint("merge"), "p", "r")
    assert "Exchange" not in physical(left).replace("BroadcastExchange", "")
    assert sorted(r.job_id for r in left.collect()) == list(range(1, 50, 2))


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    assert buckets_for(spark.range(25), spark.range(31), least=1, rows_per_bucket=10) == 4
    assert buckets_for(spark.range(25), spark.range(0)) == 8
    day = F.lit("1997-01-02 00:00:00").cast("timestamp_ntz")
    spark.range(12).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"),
                           day.alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    # Listing 0 has most of the scores.
    spark.range(205).select(F.when(F.col("id") < 12, F.col("id")).otherwise(0).alias("l_orderkey"), F.lit(1).alias("l_partkey"), F.lit(2).alias("l_suppkey"),
                            F.col("id").alias("l_linenumber"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit(5.0).alias("l_quantity"),
                            F.lit(0.05).alias("l_discount"), day.alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit("n").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(scale, "buckets_for", partial(buckets_for, rows_per_bucket=10))
    found = scale.score_star_bucketed(spark, str(tmp_path))
    assert physical(found).count("SelectedBucketsCount: 21 out of 21") == 2
    assert "Exchange hashpartitioning(job_id" not in physical(found) and found.count() == 205
    # Only listing 1 has a first line.
    assert sorted(r.job_id for r in scale.unscored_bucketed(spark, str(tmp_path)).collect()) == [0, *range(2, 12)]


# --- streams of several micro-batches ------------------------------------------------------------------


def test_slices_arrive_in_order_and_dedup_state_shrinks(spark, tmp_path):
    data = [(f"f{i % 10}", 1000 * (i // 10) + i % 10) for i in range(40)] + [(f"g{i}", 4000 + 1000 * (i // 2) + i % 2) for i in range(6)]
    frame = spark.createDataFrame(data, "fingerprint string, t int")
    assert land_in_slices(frame, F.floor(F.col("t") / 1000), str(tmp_path / "in")) == 7
    stream = read_slices(spark, str(tmp_path / "in"), frame.schema)
    # Not at 0, where the first watermark is.
    once = stream_dedup(stream, "1500 seconds", F.timestamp_seconds(F.col("t") + 100_000)).select("fingerprint", "t")
    query = once.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 7
    state = [p["stateOperators"][0] for p in query.recentProgress]
    assert any(s["numRowsRemoved"] > 0 for s in state)
    totals = [s["numRowsTotal"] for s in state]
    # The fourth slice sets the time to 3009 - 1500, and the fifth drops what came up to 9.
    assert totals[3] == 10 and min(totals) <= 4 and max(totals) <= 12
    found = sorted((r.t, r.fingerprint) for r in spark.table("expiring").collect())
    assert found == sorted([(i, f"f{i}") for i in range(10)] + [(t, f) for f, t in data[40:]])


def test_late_rows_are_not_emitted(spark, tmp_path):
    data = [("a", 0, 5000), ("b", 1, 9000), ("late", 2, 100), ("c", 2, 9500), ("in time", 2, 8800)]
    frame = spark.createDataFrame(data, "fingerprint string, slice_no int, t int")
    land_in_slices(frame, F.col("slice_no"), str(tmp_path / "in"))
    once = stream_dedup(read_slices(spark, str(tmp_path / "in"), frame.schema), "1000 seconds", F.timestamp_seconds("t")).select("fingerprint")
    query = once.writeStream.format("memory").queryName("late_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.fingerprint for r in spark.table("late_rows").collect()) == ["a", "b", "c", "in time"]


@pytest.mark.parametrize("dies_at", [None, 0, 2, 4])
def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path, dies_at):
    frame = sightings(spark, 250)
    land_in_slices(frame, first_slice_of(frame, "last_seq", 5), str(tmp_path / "in"))
    seen = []

    def after(batch_id):
        seen.append(batch_id)
        if batch_id == dies_at and seen.count(batch_id) == 1:
            raise RuntimeError("died")

    def run():
        stream = read_slices(spark, str(tmp_path / "in"), frame.schema)
        assert fold_stream(stream, SPEC, str(tmp_path / "state"), str(tmp_path / "c"), after).awaitTermination(120)

    if dies_at is None:
        run()
        assert seen == [0, 1, 2, 3, 4]
    else:
        with pytest.raises(Exception, match="died"):
            run()
        run()
        assert seen == [*range(dies_at + 1), *range(dies_at, 5)]
    assert rows(folded_state(spark, str(tmp_path / "state"), frame.schema)) == rows(merge.fold(frame, SPEC))
    assert len(list((tmp_path / "state").glob("batch=*"))) == 2


def test_slices_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "v bigint")
    assert frame.select(first_slice_of(frame, "v", 4).alias("s")).count() == 0


def test_best_listings_are_ranked_on_narrow_rows(spark):
    rng = random.Random(11)
    jobs = spark.createDataFrame([(i, i % 4, f"t{i}", ["x"] * (i % 3), "u") for i in range(30)],
                                 "job_id int, company_id int, title string, locations array<string>, url string")
    companies = spark.createDataFrame([(0, "A", "g"), (1, "B", None), (2, "A", ""), (3, None, "l")], "company_id int, name string, ats_provider string")
    scores = spark.createDataFrame(
        [(rng.randrange(32), f"p{i % 2}", f"r{i}", rng.choice([10, 20]), rng.choice([1, 2]), rng.choice([None, "s"]),
          rng.choice(["named_target", "skip"]), i) for i in range(90)],
        "job_id int, profile_version string, resume_version string, qualification_score int, fit_score int, summary string, tier string, created_at int")
    found = review.best_listings(scores, jobs, companies)
    whole = review.best_per_company(review.review_columns(review.score_view(scores, jobs, companies)))
    assert [r.asDict() for r in found.collect()] == [r.asDict() for r in whole.select(*found.columns).collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and ("title" in line or "summary" in line)]
