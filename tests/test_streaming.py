import json
from datetime import datetime

from pyspark.sql import functions as F

from listwright.functions.rules import TierRules
from listwright.plans import pull as pl
from listwright.sources.feeds import Feed
from listwright.sources.store import Store
from listwright.streaming.stateless import stream_dedup, stream_tiers
from listwright.streaming.upsert import once_per_batch, stream_feed, stream_pull

DAY = datetime(2024, 5, 1, 8)


def entry(source_id, company, title):
    return {"id": source_id, "company_name": company, "title": title, "url": "https://x.test/1"}


def feed_files(folder):
    folder.mkdir()
    contents = [
        [entry("1", "Acme Inc", "A"), entry("2", "Bolt", "B")],
        [entry("1", "Acme", "A2"), entry("3", "Cargo", "C"), entry("3", "Cargo", "C2")],
        [entry("2", "Bolt LLC", "B2")],
    ]
    for number, listings in enumerate(contents):
        (folder / f"{number}.json").write_text(json.dumps(listings))
    return contents


def content(store, table, drop=("first_seq", "last_seq", "provider_seq")):
    rows = store.read(table).drop(*drop)
    return sorted(map(str, rows.collect()))


def test_stream_gives_the_same_tables_as_one_batch(spark, tmp_path):
    feed_files(tmp_path / "in")
    feed = Feed("one", str(tmp_path / "in"))
    streamed = Store(spark, str(tmp_path / "streamed"), merge_factor=100)
    raw = stream_feed(streamed, feed)
    checkpoint = str(tmp_path / "checkpoint")
    query = stream_pull(streamed, raw, "one", checkpoint, lambda: DAY)
    assert query.awaitTermination(120)
    batch = Store(spark, str(tmp_path / "batch"))
    pl.pull(batch, [feed], DAY)
    for table in ("jobs", "companies"):
        assert content(streamed, table) == content(batch, table)
    # Nothing new: nothing is committed. A new file is merged on top.
    version = streamed.current().version
    assert stream_pull(streamed, raw, "one", checkpoint, lambda: DAY).awaitTermination(120)
    assert streamed.current().version == version
    (tmp_path / "in" / "9.json").write_text(json.dumps([entry("1", "Acme", "A3")]))
    assert stream_pull(streamed, raw, "one", checkpoint, lambda: DAY).awaitTermination(120)
    titles = {r.source_id: r.title for r in streamed.read("jobs").collect()}
    assert titles == {"1": "A3", "2": "B2", "3": "C2"}


def test_repeated_micro_batch_is_skipped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.initialize()
    seen = []

    def apply(frame, batch_id, name):
        seen.append((name, batch_id))
        store.commit(store.current(), {}, name, batch_id)

    for checkpoint in ("a", "b"):
        (tmp_path / checkpoint).mkdir()
        (tmp_path / checkpoint / "metadata").write_text(json.dumps({"id": f"id-{checkpoint}"}))
    body = once_per_batch(store, "feed", str(tmp_path / "a"), apply)
    other = once_per_batch(store, "feed", str(tmp_path / "b"), apply)
    frame = spark.range(1)
    for batch_id in (0, 0, 1, 0, 1, 2):
        body(frame, batch_id)
    other(frame, 0)
    assert seen == [("feed@id-a", 0), ("feed@id-a", 1), ("feed@id-a", 2), ("feed@id-b", 0)]
    assert store.last_stream_batch("other") == -1


def test_a_new_checkpoint_loses_no_listing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for number in (1, 2):
        folder = tmp_path / f"in{number}"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps([entry(str(number), "Acme", "T")]))
        raw = stream_feed(store, Feed("one", str(folder)))
        checkpoint = str(tmp_path / f"checkpoint{number}")
        assert stream_pull(store, raw, "one", checkpoint, lambda: DAY).awaitTermination(120)
    assert sorted(r.source_id for r in store.read("jobs").collect()) == ["1", "2"]


def listings_stream(spark, folder, rows):
    schema = "company_name string, title string, fingerprint string, posted_at bigint"
    folder.mkdir()
    for number, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{number}.parquet")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/*.parquet")
    )


def collected(spark, frame, name, checkpoint):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_tiers(spark, tmp_path):
    rules = TierRules(named=("acme",), keywords=(r"\bops\b",), skips=())
    rows = [[("Acme", "x", "f", 1), ("Bolt", "Ops", "f", 1)], [("Bolt", "x", "f", 1)]]
    stream = listings_stream(spark, tmp_path / "in", rows)
    got = collected(spark, stream_tiers(stream, "all", rules), "tiers", str(tmp_path / "c"))
    assert sorted((r.company_name, r.tier) for r in got) == [
        ("Acme", "named_target"), ("Bolt", "keyword"),
    ]


def test_stream_dedup_by_arrival_and_by_posting_time(spark, tmp_path):
    rows = [
        [("Acme", "x", "f1", 9000), ("Acme", "x", "f1", 9010), ("Bolt", "y", "f2", None)],
        [("Acme", "x", "f1", 100), ("Cargo", "z", "f3", 8000), ("Bolt", "y", "f2", 1)],
    ]
    stream = listings_stream(spark, tmp_path / "in", rows)
    arrival = stream_dedup(stream, "1 hour").select("fingerprint")
    got = collected(spark, arrival, "by_arrival", str(tmp_path / "c1"))
    assert sorted(r.fingerprint for r in got) == ["f1", "f2", "f3"]
    posted = stream.filter("posted_at IS NOT NULL")
    by_time = stream_dedup(posted, "1 hour", F.timestamp_seconds("posted_at"))
    got = collected(spark, by_time.select("fingerprint"), "by_posting", str(tmp_path / "c2"))
    assert sorted(r.fingerprint for r in got)[:1] == ["f1"]


def test_lines_feed_streams_too(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"pos": i, "listing": entry(str(i), "Acme", "T")} for i in range(3)]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    store = Store(spark, str(tmp_path / "s"))
    raw = stream_feed(store, Feed("one", str(folder), layout="lines"))
    assert stream_pull(store, raw, "one", str(tmp_path / "c")).awaitTermination(120)
    assert store.read("jobs").select(F.countDistinct("job_id")).first()[0] == 3
