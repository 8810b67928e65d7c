"""What a larger table must not make more of, and short cuts that must change no result."""

from pyspark.sql import functions as F

from fleetlens.functions import cube, geodesy
from fleetlens.operators import counting, skew
from fleetlens.sources import polygons as polygon_source


def riders(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("u"), F.col("id")).alias("user_id"), (1.3 + (F.col("id") * 7919 % 2003 - 1001) / 30000).alias("lat"),
        (103.8 + (F.col("id") * 104729 % 2011 - 1005) / 30000).alias("lng"))


def centres(spark, n):
    return spark.range(n).select(
        F.col("id").alias("qid"), (1.3 + F.col("id") % 97 / 5000).alias("lat"), (103.8 + F.col("id") % 89 / 5000).alias("lng"),
        (F.lit(300.0) + F.col("id") * 97 % 2500).alias("radius_m"))


def test_no_row_made_for_a_circle_is_stored(spark, monkeypatch):
    """Forty times the circles: what is written to the shared folder stays the same."""
    real, written = counting.stored, []

    def stored(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(counting, "stored", stored)
    sizes = []
    for n in (50, 2000):
        written.clear()
        hits = counting.hit_counts(centres(spark, n), riders(spark, 3000), "spheroid", 16)
        assert hits.count() == n
        sizes.append(sum(written))
    assert sizes[0] == sizes[1] > 0


def test_rounding_is_that_of_round(spark):
    odd = [0.0, -0.0, 0.0005, 1.0005, 2.5e-4, 0.0015, 1234.5675, 1234.56750000001, -1.0005, -0.0004, 1e8 + 0.0005, 3e15 + 0.5,
           2.0e7, 1e300, float("inf"), float("-inf"), float("nan"), None, 20015086.7965]
    x = spark.createDataFrame([(v,) for v in odd], "x double").unionByName(
        spark.range(200_000).select((F.col("id") * 7919 % 1_000_003 / 2000.0).alias("x")))
    same = geodesy.millimetres(F.col("x")).eqNullSafe(F.round("x", 3))
    assert x.where(~same).count() == 0
    zero = x.where("x = 0").select(F.expr("1 / nullif(0, 0)"), geodesy.millimetres(F.col("x")).cast("string").alias("t")).select("t")
    assert {r["t"] for r in zero.collect()} == {"0.0"}


def test_short_distances_from_chords_are_those_of_the_formula(spark):
    at = spark.range(100_000).select(
        (F.col("id") * 7919 % 17_999 / 100.0 - 89.99).alias("lat"), (F.col("id") * 104_729 % 35_999 / 100.0 - 180).alias("lng"),
        (F.col("id") % 2001 - 1000).alias("a"), (F.col("id") % 1999 - 999).alias("b"), F.pow(F.lit(10.0), -(F.col("id") % 8)).alias("s"))
    at = at.withColumns({"la": F.col("lat") + F.col("a") * F.col("s") * 1e-4, "lo": F.col("lng") + F.col("b") * F.col("s")})
    both = cube.with_vector(cube.with_vector(at, "lat", "lng", "_q"), "la", "lo", "_p")
    pair = [F.col(c) for c in ("lat", "lng", "la", "lo")]
    got, want = geodesy.chord_millimetres(cube.chord_sq("_q", "_p"), *pair), F.round(geodesy.haversine(*pair), 3)
    assert both.where(got.isNull() | (got != want)).count() == 0
    metres = both.withColumn("radius_m", geodesy.geodesic(*pair))
    for step, hits in ((0.0, 100_000), (-1e-6, 0)):
        asked = metres.withColumn("radius_m", F.col("radius_m") + step)
        asked = geodesy.with_flattened(geodesy.with_flattened(asked, "lat", "_q"), "la", "_p")
        near = geodesy.with_near(asked, "spheroid", F.lit(False) & (F.col("lat") > 90), "radius_m",
                                 ("lat", "lng", "_q"), ("la", "lo", "_p"), "near")
        assert near.select(F.sum(F.col("near").cast("int"))).head()[0] == hits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_grouped_table_is_broadcast_by_its_measured_size(spark, monkeypatch):
    """Catalyst takes positions to be as large as the pings they come from."""
    from fleetlens import session
    from fleetlens.operators import areas, radius

    people = riders(spark, 500).groupBy("user_id").agg(F.max("lat").alias("lat"), F.max("lng").alias("lng"))
    want = sorted(map(tuple, radius.range_join(centres(spark, 40), people).collect()))
    box = spark.createDataFrame([(1, [1.28, 1.32, 1.32, 1.28], [103.78, 103.78, 103.82, 103.82])],
                                "pid long, lats array<double>, lngs array<double>")
    table = polygon_source.from_arrays(box)
    inside = sorted(map(tuple, areas.polygon_join(table, people).collect()))
    real = session.planned_bytes
    for module in (session, radius):
        monkeypatch.setattr(module, "planned_bytes", lambda df: real(df) if "qid" in df.columns else 1 << 40)
    for df, rows in ((radius.range_join(centres(spark, 40), people), want), (areas.polygon_join(table, people), inside)):
        assert "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)
        assert sorted(map(tuple, df.collect())) == rows and rows
    assert not session.measured_small(people.withColumn("user_id", F.repeat("user_id", 100_000)))
    assert not session.measured_small(people, copies=3000)


def test_polygons_of_some_edges_need_no_function_on_lists_per_pair(spark):
    """Two parts and a hole are twelve edges: the test of a pair stays in generated code."""
    from fleetlens.operators import areas

    square = lambda x, d: f"({x} 0, {x} {d}, {x + d} {d}, {x + d} 0, {x} 0)"
    text = f"MULTIPOLYGON(({square(0, 4)}, (1 1, 1 3, 3 3, 3 1, 1 1)), ({square(6, 2)}))"
    table = polygon_source.from_wkt(spark.createDataFrame([(1, text)], "pid long, wkt string"))
    p = spark.range(900).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 30 / 6 - 0.5).alias("lat"),
                                (F.floor(F.col("id") / 30) / 3 - 0.5).alias("lng"))
    hits = areas.polygon_join(table, p, "interior")
    x, y = F.col("lng"), F.col("lat")
    big = (x > 0) & (x < 4) & (y > 0) & (y < 4) & ~((x >= 1) & (x <= 3) & (y >= 1) & (y <= 3))
    want = p.where(big | ((x > 6) & (x < 8) & (y > 0) & (y < 2)))
    assert {r["user_id"] for r in hits.collect()} == {r["user_id"] for r in want.collect()} and hits.count() > 50
    text = plan(hits)
    assert "exists(" not in text[:text.index("BroadcastHashJoin")] and "aggregate(" not in text[:text.index("_cell")]


def test_a_polygon_is_shuffled_by_tiles_and_not_once_per_cell(spark, monkeypatch):
    """Sixteen tiles to a cell's side squared: few copies, and no further shuffle before the counts."""
    from fleetlens.operators import areas

    corner = centres(spark, 400).select(F.col("qid").alias("pid"), "lat", "lng")
    table = polygon_source.from_arrays(corner.select(
        "pid", F.array(F.col("lat"), F.col("lat") + 0.02, F.col("lat") + 0.02, F.col("lat")).alias("lats"),
        F.array(F.col("lng"), F.col("lng"), F.col("lng") + 0.02, F.col("lng") + 0.02).alias("lngs")))
    sent, real = [], skew.dealt

    def dealt(df, parts, key, id, own, other):
        out = real(df, parts, key, id, own, other)
        sent.append((id, out.count()))
        return out

    monkeypatch.setattr(skew, "dealt", dealt)
    split = areas.polygon_counts(table, riders(spark, 3000), rows_per_split=100)
    assert dict(sent)["pid"] < 3 * 400      # six cells each on average
    assert sorted(split.collect()) == sorted(areas.polygon_counts(table, riders(spark, 3000)).collect())


def test_parts_of_tiles_meet_once(spark, monkeypatch):
    """Tiles divided on both sides, so that rows are copied on both: every pair still meets once."""
    monkeypatch.setattr(skew, "HELD_PER_PART", 40)
    monkeypatch.setattr(skew, "ASKED_PER_PART", 30)
    few, many = centres(spark, 200), riders(spark, 2000)
    plain = sorted(counting.hit_counts(few, many, leaf_places=16).collect())
    assert sorted(counting.hit_counts(few, many, leaf_places=16, rows_per_split=100).collect()) == plain
    assert spark.conf.get(skew.CO_PARTITION) == "true"
