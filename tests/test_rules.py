"""Hand-computed values of the scalar rules, validation, state and metrics."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import pings as rules
from fleetlens.operators import metrics, state, validate
from fleetlens.schemas import PING
from fleetlens.sources import tables, topics


def ping(seq, user="a", lat=1.0, lng=2.0, service="TAXI", heading=0.0, speed=0.0,
         accuracy=1.0, ts=1000, ingest=1100):
    return (seq, user, service, lat, lng, heading, speed, accuracy, "ON_TASK", ts, ingest)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PING)


def values(spark, column, items, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_service_types(spark):
    modes = ["car", "CAR", "motorcycle", "Motorcycle", "bus", "", None]
    assert values(spark, rules.service_type, modes, "string") == [
        "TAXI", "TAXI", "BIKE", "BIKE", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert values(spark, rules.service_type_binary, modes, "string") == [
        "TAXI", "BIKE", "BIKE", "BIKE", "BIKE", "BIKE", "BIKE"]


def test_quality(spark):
    items = [None, -1.0, 0.0, 5.0, 12.5, 20.0, 50.0, 50.1, 3.75]
    assert values(spark, rules.quality_percent, items, "double") == [
        "0%", "100%", "100%", "90%", "70%", "50%", "0%", "0%", "93%"]


def test_clean_id(spark):
    assert values(spark, rules.clean_id, ["a-1", "a1", "A_b.c", "--", None], "string") == [
        "a1", "a1", "A_bc", "", None]


def test_numbers_with_defaults(spark):
    assert values(spark, lambda c: rules.number_or(c, 1.0), ["2.5", "", None, "x"], "string") == [
        2.5, 1.0, 1.0, 1.0]


def test_violations(spark):
    df = frame(
        spark, ping(0), ping(1, user=" "), ping(2, user=None), ping(3, service=""),
        ping(4, lat=None), ping(5, lat=90.0), ping(6, lat=90.1), ping(7, lng=-180.5),
        ping(8, heading=360.0), ping(9, heading=360.5), ping(10, speed=-0.1),
        ping(11, heading=None, speed=None), ping(12, lat=None, lng=None, speed=-1.0),
    )
    got = {r.seq: r.violations for r in validate.with_violations(df).collect()}
    assert [got[i] for i in range(13)] == [
        [], ["user_id_blank"], ["user_id_blank"], ["service_type_blank"], ["latitude_missing"], [],
        ["latitude_range"], ["longitude_range"], [], ["heading_range"], ["speed_negative"], [],
        ["latitude_missing", "longitude_missing", "speed_negative"]]
    good, bad = validate.split_valid(df)
    assert {r.seq for r in good.collect()} == {0, 5, 8, 11}
    assert good.count() + bad.count() == 13
    assert validate.violation_summary(df.where("false")).count() == 0
    assert validate.valid(df.where("seq = 1")).count() == 0


def test_guards(spark):
    df = frame(spark, ping(0), ping(1, user=None), ping(2, lat=None), ping(3, ts=None))
    assert {r.seq for r in validate.producible(df).collect()} == {0, 2, 3}
    assert {r.seq for r in validate.consumable(df).collect()} == {0}


def test_id_collisions(spark):
    df = frame(spark, ping(0, "a-1"), ping(1, "a1"), ping(2, "b"), ping(3, "a-1"))
    assert [tuple(r) for r in validate.id_collisions(df).collect()] == [("a1", 2)]
    merged = state.latest_positions(df, sanitize=True).collect()
    assert {(r.user_id, r.seq) for r in merged} == {("a1", 3), ("b", 2)}


def test_arrival_or_event_time_decides(spark):
    df = frame(spark, ping(0, lat=1.0, ts=500), ping(1, lat=2.0, ts=100),
               ping(2, "b", lat=3.0, ts=100), ping(3, "b", lat=4.0, ts=100))
    late = {r.user_id: r.lat for r in state.latest_positions(df).collect()}
    event = {r.user_id: r.lat for r in state.latest_positions(df, order_by="ts_ms").collect()}
    assert late == {"a": 2.0, "b": 4.0} and event == {"a": 1.0, "b": 4.0}
    with pytest.raises(ValueError):
        state.latest_positions(df, order_by="lat")


def test_upsert_keeps_the_first_service_and_nulls(spark):
    df = frame(spark, ping(0, service="BIKE", accuracy=5.0), ping(1, service="TAXI", accuracy=None))
    row = state.upsert_positions(df).first()
    assert (row.service_type, row.accuracy, row.seq) == ("BIKE", None, 1)
    # Any service type that is not blank is kept.
    assert state.upsert_positions(frame(spark, ping(0, service="PLANE"))).first().service_type == "PLANE"


def test_merge_of_an_old_batch_moves_nobody_back(spark):
    stored = state.reduce_pings(frame(spark, ping(5, "a", lat=9.0, service="TAXI")))
    old = frame(spark, ping(2, "a", lat=3.0, service="BIKE"))
    row = state.upsert_merge(stored, old).first()
    assert (row.lat, row.seq, row.service_type, row.first_seq) == (9.0, 5, "BIKE", 2)


def test_merge_moves_adds_and_keeps(spark):
    stored = state.upsert_positions(frame(spark, ping(0, "a", service="BIKE"), ping(1, "b", lat=7.0)))
    delta = frame(spark, ping(2, "a", lat=5.0, service="TAXI"), ping(3, "c", service="TAXI"))
    got = {r.user_id: (r.lat, r.service_type, r.seq) for r in
           state.upsert_merge(stored, delta).collect()}
    assert got == {"a": (5.0, "BIKE", 2), "b": (7.0, "TAXI", 1), "c": (1.0, "TAXI", 3)}


def test_status_expires(spark):
    df = frame(spark, ping(0, "a", ingest=0), ping(1, "b", ingest=1_000_000), ping(2, "a", ingest=10))
    alive = {r.user_id for r in state.active_status(df, 1_800_010).collect()}
    assert alive == {"b"}
    assert {r.user_id for r in state.active_status(df, 1_800_009).collect()} == {"a", "b"}
    kept = state.active_only(state.latest_positions(df), state.active_status(df, 1_800_010))
    assert [r.user_id for r in kept.collect()] == ["b"]


def test_decode_numeric_is_per_field(spark):
    row = {name: None for name in topics.MAP_FIELDS}
    row.update(trj_id="a", pingtimestamp="12", speed="x", bearing="90.0", accuracy="null")
    df = spark.createDataFrame([{**row, "seq": 1, "ingest_ms": 2}],
                               ", ".join(f"{n} string" for n in topics.MAP_FIELDS)
                               + ", seq long, ingest_ms long")
    got = topics.decode_numeric(df).first()
    assert (got.pingtimestamp, got.speed, got.bearing, got.accuracy) == (12, None, 90, None)
    assert got.parse_errors == ["speed", "accuracy"]


def test_lag(spark):
    df = frame(spark, ping(0, ts=1000, ingest=1100), ping(1, ts=0), ping(2, ts=None),
               ping(3, ts=1200, ingest=1100))
    assert {(r.seq, r.lag_ms) for r in metrics.with_lag(df).collect()} == {(0, 100), (3, -100)}
    hist = metrics.freshness_histogram(df, 60_000).first()
    assert (hist.le_100, hist.le_500, hist.n) == (1, 1, 1)


def test_bucket_quantile(spark):
    bounds = (100, 500, 1000)
    df = spark.createDataFrame(
        [(0, 10, 20, 20, 20), (1, 0, 0, 5, 10), (2, 0, 0, 0, 0), (3, 20, 20, 20, 20)],
        "i int, le_100 int, le_500 int, le_1000 int, n int")
    got = df.select("i", metrics.bucket_quantile(0.75, bounds, F.col("n")).alias("q")).orderBy("i")
    assert [r.q for r in got.collect()] == [300.0, 1000.0, None, 75.0]


def test_counter_increase_over_windows_and_restarts(spark):
    rows = [(i, t, "s", v) for i, (t, v) in enumerate(
        [(0, 5.0), (10, 8.0), (100, 9.0), (110, 2.0), (350, 4.0), (360, None), (370, 4.0)])]
    df = spark.createDataFrame(rows, "seq long, ts_ms long, series string, value double")
    for piece in (100, 10, 7):
        got = metrics.counter_increase(df, 100, piece).orderBy("window_ms").collect()
        assert [(r.window_ms, r.increase) for r in got] == [(0, 3.0), (100, 3.0), (300, 2.0)]


def test_error_rate_and_bands(spark):
    df = spark.createDataFrame(
        [("a", "write", 0, 503, "SERVER_ERROR"), ("a", "write", 0, 200, "SERVER_ERROR"),
         ("a", "write", 0, 200, "SUCCESS"), ("a", "write", 0, 200, "SUCCESS")],
        "application string, class string, ts_ms long, status int, outcome string")
    assert metrics.error_rate(df, 1000).first().error_pct == 50.0
    assert values(spark, lambda c: metrics.band(c, 1.0, 5.0), [0.9, 1.0, 4.9, 5.0], "double") == [
        "green", "yellow", "yellow", "red"]


def test_position_table_round_trip(spark, tmp_path):
    df = state.upsert_positions(frame(spark, ping(0), ping(1, "b", lat=None)))
    tables.write_positions(df, str(tmp_path / "p"))
    back = tables.read_positions(spark, str(tmp_path / "p"))
    assert {r.user_id: r.lat for r in back.collect()} == {"a": 1.0, "b": None}


def test_samples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "app", "cpu", "s", 0.5)],
                               "seq long, ts_ms long, application string, metric string, "
                               "series string, value double")
    df.write.parquet(str(tmp_path / "s"))
    assert metrics.gauge_last(tables.read_samples(spark, str(tmp_path / "s"))).first().value == 0.5


def test_ping_json(spark):
    df = frame(spark, ping(7, "a", lat=1.5, service="BIKE"), ping(8, None), ping(9, ts=None))
    sent = topics.encode_kv(df)
    first = sent.where("seq = 7").first()
    assert first.key == "a"
    assert first.value == (
        '{"userId":"a","serviceType":"BIKE","latitude":1.5,"longitude":2.0,"heading":0.0,'
        '"speed":0.0,"accuracy":1.0,"status":"ON_TASK","timestamp":1000}')
    assert {r.seq for r in sent.collect()} == {7, 9}
    assert {r.seq: r.ts_ms for r in topics.decode_pings(sent).collect()} == {7: 1000, 9: None}
    filled = topics.decode_pings(sent, arrival_as_timestamp=True).collect()
    assert {r.seq: r.ts_ms for r in filled} == {7: 1000, 9: 1100}
