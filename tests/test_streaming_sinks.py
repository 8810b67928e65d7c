"""Sinks that take no batch twice, expiry as events, and chained windows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import metrics
from fleetlens.plans import catalog, inputs
from fleetlens.sources import topics
from fleetlens.streaming import jobs

TTL = 1000


def messages(spark, path):
    return topics.message_stream(spark, "parquet", path=path, maxFilesPerTrigger="1")


def test_a_repeated_batch_adds_no_message(spark, sf, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    sent = topics.encode_kv(inputs.valid_pings(spark, sf)).cache()
    topics.write_topic(sent.repartition(3, "seq"), source)
    topics.start_topic(messages(spark, source), out, checkpoint).awaitTermination()
    assert topics.read_topic(spark, out).exceptAll(sent).count() == 0 and topics.read_topic(spark, out).count() == sent.count()
    # as after a failure between the sink's log and the checkpoint: the last batch is run again
    commits = sorted((Path(checkpoint) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for part in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        part.unlink(missing_ok=True)
    job = topics.start_topic(messages(spark, source), out, checkpoint)
    job.awaitTermination()
    assert job.lastProgress is not None
    assert topics.read_topic(spark, out).count() == sent.count()
    # a stream over the copy sees each message once, and a key's messages of a batch lie in one file
    jobs.start(messages(spark, out), str(tmp_path / "again"), str(tmp_path / "c2")).awaitTermination()
    assert jobs.read_batches(spark, str(tmp_path / "again")).count() == sent.count()
    files = topics.read_topic(spark, out).select("key", F.input_file_name().alias("file")).distinct().groupBy("key").count()
    assert files.agg(F.max("count")).head()[0] <= 3


def test_both_halves_of_a_failed_batch_are_written_again(spark, sf, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    sent = inputs.poisoned_messages(topics.encode_kv(inputs.pings(spark, sf))).cache()
    topics.write_topic(sent.repartition(2, "seq"), source)
    stream = topics.ping_stream(spark, "parquet", path=source, maxFilesPerTrigger="1")
    # what a task left behind that wrote one half and failed
    half = topics.decode_pings(spark.read.parquet(source)).limit(5)
    topics.marked_poison(half).where("not poison").drop("poison").write.parquet(f"{out}/batch=0/poison=false")
    jobs.start_divided(stream, out, checkpoint).awaitTermination()
    poison = sent.where("seq % 67 = 0 or seq % 71 = 0")
    good = sent.join(poison, "seq", "left_anti").join(inputs.pings(spark, sf).where("latitude is not null"), "seq", "left_semi")
    assert sorted(r[0] for r in jobs.put_aside(spark, out).select("seq").collect()) == sorted(r[0] for r in poison.select("seq").collect())
    assert sorted(r[0] for r in jobs.applied(spark, out).select("seq").collect()) == sorted(r[0] for r in good.select("seq").collect())
    assert jobs.applied(spark, str(tmp_path / "none")).count() == jobs.put_aside(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def writes(spark, tmp_path):
    """A function that adds a file of writes (rider, ms) to a folder, and a stream over the folder."""
    path = str(tmp_path / "writes")

    def add(*rows):
        spark.createDataFrame(rows, "user_id string, ingest_ms long").coalesce(1).write.mode("append").parquet(path)

    return add, lambda: spark.readStream.schema("user_id string, ingest_ms long").option("maxFilesPerTrigger", 1).parquet(path)


def test_expiry_is_told_once_and_survives_a_restart(spark, tmp_path, writes):
    jobs.use_rocksdb(spark)
    add, stream = writes
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        expiry = jobs.status_expiry(stream(), "0 seconds", TTL)
        jobs.start(expiry, out, checkpoint).awaitTermination()
        return sorted((r["user_id"], r["last_ms"], r["expired_ms"]) for r in jobs.read_batches(spark, out).collect())

    add(("a", 10_000), ("b", 10_000), ("b", 10_900), ("c", 8_000), ("c", 9_500), ("c", 9_400))
    # c was away for 1500 ms within one batch; nobody else is over
    assert run() == [("c", 8_000, 9_000), ("c", 9_500, 10_500)]
    # a writes just in time; b, never again; the stream's time goes on through d, after a restart
    add(("a", 10_999), ("d", 11_500))
    add(("d", 12_300))
    assert run() == [("a", 10_999, 11_999), ("b", 10_900, 11_900), ("c", 8_000, 9_000), ("c", 9_500, 10_500)]
    # whoever comes back begins anew
    add(("a", 20_000), ("d", 20_000))
    got = run()
    assert got[0] == ("a", 10_999, 11_999) and ("d", 12_300, 13_300) in got and len(got) == 5


@pytest.mark.parametrize("files", [1, 3, 11])
def test_chained_windows_for_any_split(spark, sf, tmp_path, files):
    jobs.use_rocksdb(spark)
    rows = metrics.classify(inputs.requests(spark, sf), inputs.WRITE_URI, inputs.READ_URI).cache()
    low, high = rows.agg(F.min("ts_ms"), F.max("ts_ms")).head()
    path, step = str(tmp_path / "in"), (high - low) // files + 1
    for i in range(files):
        rows.where(F.col("ts_ms").between(low + i * step, low + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    width, slide = 3 * inputs.HOUR_MS, 2 * inputs.HOUR_MS       # panes of an hour
    out = str(tmp_path / "out")
    jobs.start(jobs.sliding_throughput(stream, width, slide), out, str(tmp_path / "c")).awaitTermination()
    got = {(r["application"], r["class"], r["window_ms"]): round(r["rps"], 9) for r in jobs.read_batches(spark, out).collect()}
    want = {(r["application"], r["class"], r["window_ms"]): round(r["rps"], 9)
            for r in metrics.sliding_throughput(rows, width, slide).collect() if r["window_ms"] + width <= high - 60_000}
    assert got == want


def test_topics_in_order_of_time_grow_in_files(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 50)
    rows = topics.encode_kv(inputs.valid_pings(spark, sf)).cache()
    options = catalog._in_order(spark, rows, "ingest_ms")
    files = int(options["maxFilesPerTrigger"])
    assert files > 1
    read = spark.read.parquet(options["path"])
    assert read.drop("_part").exceptAll(rows).count() == 0 and read.count() == rows.count()
    times = read.groupBy(F.input_file_name().alias("f")).agg(F.min("ingest_ms"), F.max("ingest_ms")).collect()
    assert len(times) % files == 0 and len(times) > catalog.LEAST_FILES
    # what a stream reads at a time is one stretch: no later batch goes back in time
    seen = []
    job = topics.message_stream(spark, "parquet", **options).writeStream.foreachBatch(
        lambda b, i: seen.append(b.agg(F.min("ingest_ms"), F.max("ingest_ms")).head()[:])).trigger(availableNow=True).start()
    job.awaitTermination()
    assert len(seen) == len(times) // files and all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))


def test_state_is_divided_by_the_work_of_a_batch(spark, tmp_path, writes):
    jobs.use_rocksdb(spark)
    add, stream = writes
    add(("a", 10_000), ("b", 10_900))
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get(jobs.PARTITIONS)
    spark.conf.set(jobs.PARTITIONS, "40")
    try:
        for wanted, got in ((1, cores), (cores + 3, cores + 3), (None, 40)):
            job = jobs.start(jobs.status_expiry(stream(), "0 seconds", TTL), str(tmp_path / f"o{wanted}"),
                             str(tmp_path / f"c{wanted}"), partitions=wanted)
            job.awaitTermination()
            assert job.lastProgress.stateOperators[0].numShufflePartitions == got
            assert spark.conf.get(jobs.PARTITIONS) == "40"
    finally:
        spark.conf.set(jobs.PARTITIONS, before)


def test_expiry_has_no_python_state(spark, writes):
    add, stream = writes
    add(("a", 10_000))
    plan = jobs.status_expiry(stream(), "0 seconds", TTL)._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["stream_status_expiry", "stream_status_periods", "stream_sliding_throughput",
                                  "stream_sliding_latency", "stream_freshness", "stream_latest"])
def test_registered_streams_open_no_state_without_work(spark, sf, monkeypatch, name):
    started, start = [], jobs.start

    def seen(*args, **kw):
        started.append(start(*args, **kw))
        return started[-1]

    monkeypatch.setattr(jobs, "start", seen)
    before = spark.conf.get(jobs.PARTITIONS)
    spark.conf.set(jobs.PARTITIONS, "40")
    try:
        catalog.QUERIES[name](spark, sf)
    finally:
        spark.conf.set(jobs.PARTITIONS, before)
    states = [s for p in started[0].recentProgress for s in p.stateOperators]
    # one file a batch: a part per core will do
    assert states and {s.numShufflePartitions for s in states} == {spark.sparkContext.defaultParallelism}
