"""A position table in versions: nothing is lost between writers, and old versions stay readable."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import state
from fleetlens.plans import inputs
from fleetlens.sources import topics, versions
from fleetlens.streaming import jobs
from tests.test_streaming import same


def part(pings, i, n):
    return state.reduce_pings(pings.where(F.col("seq") % n == i))


def upto(pings, commits, n):
    return state.reduce_pings(pings.where((F.col("seq") % n).isin(commits)))


def test_versions_folding_and_removal(spark, sf, tmp_path):
    path, pings = str(tmp_path / "t"), inputs.valid_pings(spark, sf).cache()
    assert versions.latest(spark, path) == -1 and versions.positions_as_of(spark, path).count() == 0
    assert [versions.commit(part(pings, i, 4), path) for i in range(3)] == [0, 1, 2]
    for v in range(3):
        assert same(upto(pings, list(range(v + 1)), 4), versions.positions_as_of(spark, path, v))
    assert versions.fold(spark, path) == 3
    assert versions.commit(part(pings, 3, 4), path) == 4
    for v, commits in ((1, [0, 1]), (3, [0, 1, 2]), (4, [0, 1, 2, 3])):
        assert same(upto(pings, commits, 4), versions.positions_as_of(spark, path, v))
    versions.remove_before(spark, path, 4)
    assert same(state.reduce_pings(pings), versions.positions_as_of(spark, path))
    assert same(upto(pings, [0, 1, 2], 4), versions.positions_as_of(spark, path, 3))
    with pytest.raises(ValueError):
        versions.positions_as_of(spark, path, 1)
    folders = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]
    assert len(folders) == 2
    versions.fold(spark, path)
    versions.remove_before(spark, path, 5)
    assert same(state.reduce_pings(pings), versions.positions_as_of(spark, path))


def test_a_number_has_one_winner(spark, sf, tmp_path):
    path, pings = str(tmp_path / "t"), inputs.valid_pings(spark, sf).cache()
    parts = [part(pings, i, 6).cache() for i in range(6)]
    with ThreadPoolExecutor(3) as pool:
        taken = list(pool.map(lambda p: versions.commit(p, path), parts))
    assert sorted(taken) == list(range(6))
    assert same(state.reduce_pings(pings), versions.positions_as_of(spark, path))
    # a number that is taken is refused
    assert not versions._take(spark, path, {"version": 3, "folder": "x", "writer": None, "batch": None, "upto": None})
    assert same(state.reduce_pings(pings), versions.positions_as_of(spark, path))


def test_what_is_not_listed_is_not_there(spark, sf, tmp_path):
    path, pings = str(tmp_path / "t"), inputs.valid_pings(spark, sf).cache()
    versions.commit(part(pings, 0, 2), path)
    part(pings, 1, 2).write.parquet(f"{path}/data-of-a-writer-that-failed")
    assert same(part(pings, 0, 2), versions.positions_as_of(spark, path))


def test_two_streams_into_one_table(spark, sf, tmp_path):
    path, pings = str(tmp_path / "t"), inputs.valid_pings(spark, sf).cache()

    def stream(i):
        source = str(tmp_path / f"topic{i}")
        topics.write_topic(topics.encode_kv(pings.where(F.col("seq") % 2 == i)).repartition(3, "seq"), source)
        return jobs.ingest(topics.ping_stream(spark, "parquet", path=source, maxFilesPerTrigger="1"))

    started = [versions.start_commits(stream(i), path, str(tmp_path / f"c{i}"), f"job{i}") for i in range(2)]
    for job in started:
        job.awaitTermination()
    assert versions.latest(spark, path) == 5
    assert same(state.reduce_pings(pings), versions.positions_as_of(spark, path))
    # a batch that is run again adds no version
    assert versions.commit(part(pings, 0, 2), path, "job0", 2) < 6 and versions.latest(spark, path) == 5
