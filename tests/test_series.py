"""Rates over ranges, arithmetic between series, and bounds that are fractions."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import polygons
from fleetlens.operators import areas, metrics
from fleetlens.sources import polygons as polygon_source

SAMPLE = "metric string, labels map<string,string>, ts_ms long, value double"


def one_series(spark, points):
    return spark.createDataFrame([("s", t, i, v) for i, (t, v) in enumerate(points)], "series string, ts_ms long, seq long, value double")


def rates(df):
    return {r["window_ms"]: round(r["rate"], 9) for r in df.collect()}


def test_rate_of_a_range_by_hand(spark):
    # a restart at 25 s: 10 + 5 + 20 inside [0, 40)
    points = [(5_000, 100.0), (15_000, 110.0), (25_000, 5.0), (35_000, 25.0), (45_000, None), (47_000, 30.0)]
    got = rates(metrics.counter_rate_sliding(one_series(spark, points), 40_000, 20_000))
    assert got == {0: 35 / 40, -20_000: 10 / 40, 20_000: 25 / 40}
    assert rates(metrics.counter_rate_sliding(one_series(spark, [(1, 3.0), (1, 4.0)]), 10, 5)) == {}


def test_extrapolation_by_hand(spark):
    # samples every 10 s from 5 s on: both edges are within 1.1 distances, so 30 s stand for 40 s
    points = [(5_000, 100.0), (15_000, 110.0), (25_000, 120.0), (35_000, 130.0)]
    got = rates(metrics.counter_rate_sliding(one_series(spark, points), 40_000, 40_000, extrapolate=True))
    assert got == {0: 30 * (40 / 30) / 40}
    # far from the start: half a distance; a counter that was zero 2 s before its first sample: 2 s
    late = rates(metrics.counter_rate_sliding(one_series(spark, [(25_000, 100.0), (35_000, 110.0)]), 40_000, 40_000, True))
    assert late == {0: 10 * ((10 + 5 + 5) / 10) / 40}
    fresh = rates(metrics.counter_rate_sliding(one_series(spark, [(5_000, 2.0), (15_000, 12.0)]), 20_000, 20_000, True))
    assert fresh == {0: 10 * ((10 + 2 + 5) / 10) / 20}


@pytest.mark.parametrize("width,slide,piece", [(60_000, 20_000, 5_000), (50_000, 20_000, 60_000), (60_000, 60_000, 7_000)])
def test_ranges_equal_plain_summaries(spark, width, slide, piece):
    points = [(i * 7919 % 400_000, float(i * 31 % 97)) for i in range(300)]
    got = {(r["window_ms"], r["n"], round(r["inside"], 6), r["first"], r["last"])
           for r in metrics.range_summaries(one_series(spark, points), width, slide, piece).collect()}
    want = set()
    ordered = sorted((t, i, v) for i, (t, v) in enumerate(points))
    for start in range(-width, 400_000, 1000):
        inside = [v for t, _, v in ordered if start <= t < start + width]
        if start % slide == 0 and inside:
            rise = sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))
            want.add((start, len(inside), round(rise, 6), inside[0], inside[-1]))
    assert got == want


def test_errors_where_a_series_is_missing(spark):
    def counter(app, status, outcome, per_ms):
        labels = {"application": app, "status": status}
        if outcome:
            labels["outcome"] = outcome
        return [("http", labels, t, t / per_ms) for t in range(0, 20_000, 1000)]

    rows = (counter("a", "200", "SUCCESS", 100.0) + counter("a", "503", "SERVER_ERROR", 300.0)
            + counter("b", "200", "SUCCESS", 100.0) + counter("c", "500", None, 50.0))
    got = metrics.sample_error_rate(spark.createDataFrame(rows, SAMPLE), "http", ["application"], 10_000)
    by_app = {(r["application"], r["window_ms"]): round(r["error_pct"], 6) for r in got.collect()}
    assert by_app == {("a", 0): 25.0, ("a", 10_000): 25.0, ("b", 0): 0.0, ("b", 10_000): 0.0, ("c", 0): 100.0, ("c", 10_000): 100.0}


def test_series_arithmetic(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (0, None, 2.0), (10, "x", 3.0)], "window_ms long, app string, rate double")
    b = spark.createDataFrame([(0, "x", 10.0), (0, None, 20.0), (0, "y", 30.0)], "window_ms long, app string, rate double")
    total = metrics.combined(a, b, ["app"], lambda x, y: x + y)
    assert {tuple(r) for r in total.collect()} == {(0, "x", 11.0), (0, None, 22.0)}
    either = metrics.or_else(a, b, ["app"])
    assert {tuple(r) for r in either.collect()} == {(0, "x", 1.0), (0, None, 2.0), (10, "x", 3.0), (0, "y", 30.0)}
    some = spark.createDataFrame([("m", {"status": "503"}, 0, 1.0), ("m", {}, 0, 2.0)], SAMPLE)
    assert metrics.labelled(some, status="5..").count() == 1 and metrics.labelled(some, status="").count() == 1


def test_bounds_that_are_fractions(spark):
    rows = [("lat", {"le": le}, t, t * n) for t in (0, 1000) for le, n in (("0.50", 5.0), ("1.0", 10.0), ("+Inf", 10.0))]
    got = metrics.sampled_quantiles(spark.createDataFrame(rows, SAMPLE), "lat", [], 10_000, (0.5, 1)).head()
    assert (round(got["p95"], 9), round(got["p99"], 9)) == (0.95, 0.99)
    pings = spark.createDataFrame([(i, 1000, 1000 + i) for i in range(10)], "seq long, ts_ms long, ingest_ms long")
    counts = metrics.freshness_histogram(pings, 10_000, (2.5, 7)).head()
    assert (counts["le_2.5"], counts["le_7"], counts["n"]) == (3, 8, 10)
    assert metrics.freshness_slo(pings, 10_000, (2.5, 7)).head()["within_2.5"] == 0.3


def test_areas_of_several_parts(spark):
    square = "(({0} 0, {0} 2, {1} 2, {1} 0, {0} 0){2})"
    wkts = {1: "MULTIPOLYGON(" + square.format(0, 2, ",(0.5 0.5,0.5 1.5,1.5 1.5,1.5 0.5,0.5 0.5)") + " , " + square.format(10, 12, "") + ")",
            2: " multipolygon ( ( ( 0 0 , 0 2 , 2 2 , 2 0 , 0 0 ) ) )", 3: "POLYGON((0 0,0 2,2 2,2 0,0 0))",
            4: "MULTIPOLYGON EMPTY", 5: "MULTIPOLYGON(((0 0,0 2)))", 6: "GEOMETRYCOLLECTION(POINT(1 1))", 7: None}
    table = polygon_source.from_wkt(spark.createDataFrame(list(wkts.items()), "pid long, wkt string")).cache()
    assert {r[0] for r in polygon_source.rejected(table).collect()} == {4, 5, 6, 7}
    sizes = {r["pid"]: r["n"] for r in table.where("rings is not null").select("pid", F.size("rings").alias("n")).collect()}
    assert sizes == {1: 3, 2: 1, 3: 1}
    box = polygons.bbox(F.col("rings"))
    assert table.where("pid = 1").select(box["min_lng"], box["max_lng"]).head()[:] == (0.0, 12.0)
    places = spark.createDataFrame([("hole", 1.0, 1.0), ("ring", 0.25, 1.0), ("east", 1.0, 11.0), ("between", 1.0, 5.0), ("edge", 1.0, 10.0)],
                                   "user_id string, lat double, lng double")
    for rule in ("interior", "winding"):
        hits = {(r["pid"], r["user_id"]) for r in areas.polygon_join(table, places, rule).collect()}
        expected = {(1, "ring"), (1, "east"), (2, "hole"), (2, "ring"), (3, "hole"), (3, "ring")}
        # under the non-zero rule a hole of the same direction is filled and a border belongs to one side
        assert hits - {(1, "hole"), (1, "edge")} == expected
        assert rule == "winding" or hits == expected
