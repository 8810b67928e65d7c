"""Streams end in the state that a batch over the same pings gives."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import metrics, state, validate
from fleetlens.plans import inputs
from fleetlens.session import shared_dir
from fleetlens.sources import topics
from fleetlens.streaming import jobs

FILES = 4


@pytest.fixture(scope="module")
def topic(spark, sf, tmp_path_factory):
    """The pings as one topic folder of several files, in shuffled arrival."""
    path = str(tmp_path_factory.mktemp("topic") / "pings")
    sent = topics.encode_kv(inputs.valid_pings(spark, sf)).repartition(FILES, "seq")
    topics.write_topic(sent, path)
    return path


def stream(spark, path):
    return jobs.ingest(topics.ping_stream(spark, "parquet", path=path, maxFilesPerTrigger="1"))


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_upserts_any_split_restart_and_compaction(spark, sf, topic, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    jobs.start_upserts(stream(spark, topic), out, checkpoint).awaitTermination()
    want = state.upsert_positions(inputs.valid_pings(spark, sf))
    assert jobs.read_batches(spark, out).select("batch").distinct().count() == FILES
    assert same(want, jobs.current_positions(spark, out))
    # A restart resumes behind the last batch and adds nothing.
    jobs.start_upserts(stream(spark, topic), out, checkpoint).awaitTermination()
    assert jobs.read_batches(spark, out).select("batch").distinct().count() == FILES
    # A replay of a batch overwrites it.
    third = jobs.read_batches(spark, out).where("batch = 2").drop("batch").cache()
    third.count()
    third.write.mode("overwrite").parquet(f"{out}/batch=2")
    assert same(want, jobs.current_positions(spark, out))
    # Old batches merge into a base, step by step.
    jobs.compact(spark, out, str(tmp_path / "base1"), upto=1)
    jobs.compact(spark, out, str(tmp_path / "base2"), upto=2, base=str(tmp_path / "base1"),
                 base_upto=1)
    assert same(want, jobs.current_positions(spark, out, base=str(tmp_path / "base2"), upto=2))
    # The job's own list of bases is found without being named; a base may be folded again.
    for upto in (0, 2):
        made = jobs.compact_to(spark, out, upto)
        assert jobs.last_base(spark, out) == (made, upto)
        assert same(want, jobs.current_positions(spark, out))


def test_stateful_latest(spark, sf, topic, tmp_path):
    jobs.use_rocksdb(spark)
    out = str(tmp_path / "out")
    jobs.start_latest(stream(spark, topic), out, str(tmp_path / "c")).awaitTermination()
    assert same(state.upsert_positions(inputs.valid_pings(spark, sf)),
                jobs.current_positions(spark, out))


def test_status_with_time_limit(spark, sf, topic, tmp_path):
    out = str(tmp_path / "out")
    jobs.start_status(stream(spark, topic), out, str(tmp_path / "c")).awaitTermination()
    valid = inputs.valid_pings(spark, sf)
    as_of = valid.agg(F.max("ingest_ms")).first()[0] - 3_600_000
    for moment in (as_of, as_of + 3_600_000):
        assert same(state.active_status(valid, moment), jobs.active_at(spark, out, moment))
    assert jobs.active_at(spark, str(tmp_path / "nothing"), as_of).count() == 0
    assert jobs.current_positions(spark, str(tmp_path / "nothing")).count() == 0


def test_status_periods(spark, sf, tmp_path):
    path = str(tmp_path / "topic")
    topics.write_topic(topics.encode_kv(inputs.valid_pings(spark, sf)), path)
    out = str(tmp_path / "out")
    periods = jobs.status_periods(stream(spark, path))
    jobs.start(periods, out, str(tmp_path / "c")).awaitTermination()
    batch = jobs.status_periods(inputs.valid_pings(spark, sf))
    last = batch.agg(F.max("expires_at")).first()[0]
    done = jobs.read_batches(spark, out).drop("batch")
    # Append mode holds back only the periods that may still be extended.
    assert done.exceptAll(batch).count() == 0
    assert batch.exceptAll(done).where(F.col("expires_at") < last - 3_600_000).count() == 0


def test_freshness_windows(spark, sf, topic, tmp_path):
    out = str(tmp_path / "out")
    jobs.start(jobs.freshness(stream(spark, topic), delay="365 days"), out,
               str(tmp_path / "c"), mode="update").awaitTermination()
    want = metrics.freshness_histogram(inputs.valid_pings(spark, sf), inputs.MINUTE_MS)
    assert same(want, jobs.latest_windows(spark, out))


def test_poison_is_put_aside(spark, sf, tmp_path):
    sent = inputs.poisoned_messages(topics.encode_kv(inputs.valid_pings(spark, sf)))
    path = str(tmp_path / "topic")
    topics.write_topic(sent, path)
    decoded = topics.decode_pings(spark.read.parquet(path))
    good, bad = topics.split_poison(decoded)
    assert bad.where("seq % 67 <> 0 and seq % 71 <> 0").count() == 0 and bad.count() > 0
    assert good.count() + bad.count() == sent.count()
    assert same(validate.consumable(inputs.valid_pings(spark, sf).where("seq % 67 <> 0 and seq % 71 <> 0")), good)


def test_polling_job_stops_on_request(spark, topic, tmp_path):
    job = jobs.start(stream(spark, topic), str(tmp_path / "o"), str(tmp_path / "c"), poll="1 second")
    job.processAllAvailable()
    job.stop()
    assert jobs.read_batches(spark, str(tmp_path / "o")).count() > 0


def test_json_topic(spark, sf, tmp_path):
    path = str(tmp_path / "topic")
    sent = topics.encode_map(topics.map_columns(inputs.valid_pings(spark, sf)))
    sent.write.json(path)
    messages = topics.message_stream(spark, "json", path=path)
    out = str(tmp_path / "out")
    jobs.start(jobs.decoded_maps(messages), out, str(tmp_path / "c")).awaitTermination()
    got = jobs.read_batches(spark, out)
    assert got.count() == sent.count()
    assert got.where("size(parse_errors) > 0").count() == 0
    with pytest.raises(ValueError):
        topics.message_stream(spark, "carrier pigeon")


def test_shared_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(f"{base}/x-") and first != second
