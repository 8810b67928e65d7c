"""Spatial joins against brute force on points all over the globe."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import geodesy, polygons
from fleetlens.operators import areas, nearest, radius, skew
from fleetlens.plans import inputs
from fleetlens.session import may_broadcast, planned_bytes
from fleetlens.sources import polygons as polygon_source

PLACES = [(90.0, 0.0), (-90.0, 12.0), (89.9, 170.0), (89.95, -10.0), (0.0, 180.0), (0.0, -180.0),
          (0.01, 179.99), (-0.01, -179.99), (45.0, 45.0), (45.0, 45.0), (1.3, 103.8), (0.0, 0.0)]


def globe(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lng = rng.uniform(-180, 180, n)
    near = rng.integers(0, len(PLACES), n // 2)
    base = np.array(PLACES)[near]
    lat[: n // 2] = np.clip(base[:, 0] + rng.normal(0, 0.05, n // 2), -90, 90)
    lng[: n // 2] = (base[:, 1] + rng.normal(0, 0.05, n // 2) + 180) % 360 - 180
    lat[-len(PLACES):], lng[-len(PLACES):] = np.array(PLACES).T
    return pd.DataFrame({"lat": lat, "lng": lng})


def haversine(lat1, lng1, lat2, lng2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.sqrt(np.minimum(1, h)))


def lambert(lat1, lng1, lat2, lng2):
    f = 1 / 298.257223563
    b1, b2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat1, lat2))
    h = np.sin((b2 - b1) / 2) ** 2 + np.cos(b1) * np.cos(b2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    with np.errstate(all="ignore"):
        s = 2 * np.arcsin(np.sqrt(np.minimum(1, h)))
        p, q = (b1 + b2) / 2, (b2 - b1) / 2
        x = (s - np.sin(s)) * (np.sin(p) * np.cos(q) / np.cos(s / 2)) ** 2
        y = (s + np.sin(s)) * (np.cos(p) * np.sin(q) / np.sin(s / 2)) ** 2
        d = 6378137.0 * (s - f / 2 * (x + y))
    return np.where(h == 0, 0.0, np.where(h >= 1, haversine(lat1, lng1, lat2, lng2), d))


BRUTE = {"sphere": haversine, "spheroid": lambert}


def pairs(q: pd.DataFrame, p: pd.DataFrame, metric: str) -> pd.DataFrame:
    x = q.merge(p, how="cross", suffixes=("", "_p"))
    x["d"] = BRUTE[metric](x.lat, x.lng, x.lat_p, x.lng_p)
    return x


@pytest.fixture(scope="module")
def world(spark):
    q, p = globe(150, 1), globe(600, 2)
    q["qid"] = range(len(q))
    q["radius_m"] = [float([0, 200, 5_000, 60_000, 3_000_000, 21_000_000][i % 6]) for i in q.qid]
    q["k"] = [(1, 5, 40, 700)[i % 4] for i in q.qid]
    p["user_id"] = [f"u{i:04d}" for i in range(len(p))]
    return q, p, spark.createDataFrame(q).cache(), spark.createDataFrame(p).cache()


@pytest.mark.parametrize("metric", ["sphere", "spheroid"])
@pytest.mark.parametrize("rows_per_split", [None, 50])
def test_range_join_is_brute_force(world, metric, rows_per_split):
    q, p, sq, sp = world
    got = radius.range_join(sq, sp, metric, rows_per_split=rows_per_split).toPandas()
    x = pairs(q, p, metric)
    want = x[x.d <= x.radius_m]
    assert len(got) == len(set(zip(got.qid, got.user_id)))
    assert set(zip(got.qid, got.user_id)) == set(zip(want.qid, want.user_id))


@pytest.mark.parametrize("metric,cap,rows_per_split", [
    ("sphere", None, None), ("spheroid", None, 50), ("sphere", 100_000.0, None),
])
def test_knn_join_is_brute_force(world, metric, cap, rows_per_split):
    q, p, sq, sp = world
    got = nearest.knn_join(sq, sp, metric, cap, rows_per_split=rows_per_split).toPandas()
    x = pairs(q, p, metric)
    if cap:
        x = x[x.d <= cap]
    x["r"] = x.d.round(3)
    x = x.sort_values(["qid", "r", "user_id"])
    x["rank"] = x.groupby("qid").cumcount() + 1
    want = x[x["rank"] <= x.k]
    assert set(zip(got.qid, got.user_id, got["rank"])) == set(zip(want.qid, want.user_id, want["rank"]))


def test_spheroid_stays_within_the_pad():
    q, p = globe(400, 5), globe(400, 6)
    q["qid"], p["user_id"] = range(400), range(400)
    x = pairs(q, p, "spheroid")
    x = x[x.d > 1]
    ratio = haversine(x.lat, x.lng, x.lat_p, x.lng_p) / x.d
    assert ratio.max() < geodesy.SPHEROID_PAD and ratio.min() > 1 / geodesy.SPHEROID_PAD


def test_a_third_of_all_riders_on_one_spot(spark):
    crowd = spark.range(3000).select(
        F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("user_id"),
        F.when(F.col("id") % 3 == 0, 1.3).otherwise(1.2 + F.col("id") / 10000).alias("lat"),
        F.when(F.col("id") % 3 == 0, 103.8).otherwise(103.7 + F.col("id") / 9000).alias("lng"),
    ).cache()
    centres = spark.range(40).select(
        F.col("id").alias("qid"), F.lit(1.3).alias("lat"), F.lit(103.8).alias("lng"),
        F.lit(300.0).alias("radius_m"), F.lit(7).alias("k"),
    )
    at_spot = crowd.where("lat = 1.3 and lng = 103.8").count()
    hits = radius.range_join(centres, crowd, rows_per_split=100)
    counts = radius.hit_counts(centres, hits).toPandas()
    assert (counts.hits >= at_spot).all() and counts.hits.nunique() == 1
    asking = centres.select(F.col("lng"))
    parts = skew.hot_keys(asking, crowd, "lng", 100).toPandas()
    assert parts._parts.tolist() == [2]     # 1000 rows meet 40 queries: few comparisons
    many = spark.range(100_000).select(F.lit(103.8).alias("lng"))
    assert 2 < skew.hot_keys(many, crowd, "lng", 100).head()._parts <= 10
    # Of the stack only k riders per query are ever compared, and the first ids win.
    knn = nearest.knn_join(centres, crowd, max_k=7).toPandas()
    assert len(knn) == 40 * 7
    first = [f"u{i:05d}" for i in range(0, 21, 3)]
    assert knn.sort_values("rank").groupby("qid").user_id.apply(list).tolist() == [first] * 40


def test_edges_of_searches(world, spark):
    _, p, sq, sp = world
    none = sp.where("false")
    assert radius.range_join(sq, none).count() == 0
    assert nearest.knn_join(sq, none, max_k=5).count() == 0
    assert radius.range_join(sq.where("false"), sp).count() == 0
    assert nearest.knn_join(sq.where("false"), sp).count() == 0
    assert nearest.knn_search(sp, 1.3, 103.8, 5000).count() == len(p)
    assert radius.range_search(sp, 45.0, 45.0, 0.0).count() == 2
    assert radius.queries_without_hits(sq, radius.range_join(sq, none)).count() == sq.count()
    with pytest.raises(ValueError):
        geodesy.distance("flat", F.lit(0), F.lit(0), F.lit(0), F.lit(0))


def test_distances_against_known_values(spark):
    row = spark.range(1).select(
        geodesy.haversine(*map(F.lit, (0.0, 0.0, 0.0, 90.0))).alias("quarter"),
        geodesy.geodesic(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("degree"),
        geodesy.geodesic(*map(F.lit, (5.0, 5.0, 5.0, 5.0))).alias("same"),
        geodesy.geodesic(*map(F.lit, (0.0, 0.0, 0.0, 180.0))).alias("antipode"),
    ).first()
    assert row.quarter == pytest.approx(math.pi / 2 * 6371000)
    assert row.degree == pytest.approx(111319.49, abs=0.01)
    assert row.same == 0.0
    assert row.antipode == pytest.approx(math.pi * 6371000)


# ---- polygons -----------------------------------------------------------------------


def star(rng, n):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.02, 0.3, n)
    return [(round(10 + a, 4), round(50 + b, 4))
            for a, b in zip((r * np.cos(angle)).tolist(), (r * np.sin(angle)).tolist())]


def ray_cast(ring, x, y):
    """Independent even-odd test."""
    inside = np.zeros(len(x), bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        with np.errstate(all="ignore"):
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def test_polygon_join_is_ray_casting(spark):
    rng = np.random.default_rng(3)
    rings = [star(rng, n) for n in (3, 4, 7, 30, 200)]
    table = spark.createDataFrame(
        [(i, [p[1] for p in r], [p[0] for p in r]) for i, r in enumerate(rings)],
        "pid long, lats array<double>, lngs array<double>",
    )
    p = pd.DataFrame({"lng": rng.uniform(9.6, 10.4, 800), "lat": rng.uniform(49.6, 50.4, 800)})
    p["user_id"] = [f"u{i}" for i in range(800)]
    sp = spark.createDataFrame(p).cache()
    want = {(i, u) for i, r in enumerate(rings)
            for u in p.user_id[ray_cast(r, p.lng.values, p.lat.values)]}
    for split in (None, 40):
        got = areas.polygon_join(polygon_source.from_arrays(table), sp, rows_per_split=split)
        assert {(r.pid, r.user_id) for r in got.collect()} == want
    one = areas.polygon_search(sp, [rings[3]]).collect()
    assert {r.user_id for r in one} == {u for i, u in want if i == 3}


def test_border_rules(spark):
    p = spark.createDataFrame(
        [("inside", 0.5, 0.5), ("left", 0.5, 0.0), ("right", 0.5, 1.0), ("bottom", 0.0, 0.5),
         ("top", 1.0, 0.5), ("corner", 0.0, 0.0), ("in_hole", 0.3, 0.3), ("hole_edge", 0.2, 0.3)],
        "user_id string, lat double, lng double",
    )
    wkt = "POLYGON((0 0, 0 1, 1 1, 1 0, 0 0), (0.2 0.2, 0.2 0.4, 0.4 0.4, 0.4 0.2, 0.2 0.2))"
    table = polygon_source.from_wkt(spark.createDataFrame([(1, wkt)], "pid long, wkt string"))
    names = lambda df: {r.user_id for r in df.collect()}
    assert names(areas.polygon_join(table, p, "interior")) == {"inside"}
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]]
    half_open = {"inside", "left", "bottom", "corner", "in_hole", "hole_edge"}
    assert names(areas.polygon_search(p, square)) == half_open
    plain = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])],
                                  "pid long, lats array<double>, lngs array<double>")
    assert names(areas.polygon_join(polygon_source.from_arrays(plain), p)) == half_open
    strict = areas.inside(F.col("lat"), F.col("lng"), square, "interior")
    assert names(p.where(strict)) == {"inside", "in_hole", "hole_edge"}
    with pytest.raises(ValueError):
        areas.polygon_join(table, p, "outer")


def test_self_crossing_polygon_uses_the_non_zero_rule(spark):
    # A pentagram: its middle is wound twice.
    ring = [(math.sin(a), math.cos(a)) for a in (i * 4 * math.pi / 5 for i in range(5))]
    p = spark.createDataFrame([("middle", 0.0, 0.0)], "user_id string, lat double, lng double")
    table = spark.createDataFrame([(1, [y for _, y in ring], [x for x, _ in ring])],
                                  "pid long, lats array<double>, lngs array<double>")
    rings = polygon_source.from_arrays(table)
    assert areas.polygon_join(rings, p, "winding").count() == 1
    assert areas.polygon_join(rings, p, "interior").count() == 0


def test_rejected_polygons(spark):
    texts = ["POLYGON((0 0, 1 1))", "POINT(1 2)", "POLYGON((0 0, 1 x, 1 1))", None, "",
             "polygon (( 0 0 ,1 0, 1 1 ))"]
    table = polygon_source.from_wkt(
        spark.createDataFrame(list(enumerate(texts)), "pid long, wkt string"))
    assert [r.pid for r in table.where("rings is not null").collect()] == [5]
    lists = spark.createDataFrame(
        [(0, None, [1.0]), (1, [1.0, 2.0, 3.0], [1.0, 2.0]), (2, [1.0, 2.0], [1.0, 2.0]),
         (3, [0.0, 0.0, 1.0], [0.0, 1.0, 1.0])],
        "pid long, lats array<double>, lngs array<double>")
    ok = lists.where(polygons.arrays_valid(F.col("lats"), F.col("lngs")))
    assert [r.pid for r in ok.collect()] == [3]
    p = spark.createDataFrame([("u", 0.2, 0.5)], "user_id string, lat double, lng double")
    hits = areas.polygon_join(polygon_source.from_arrays(lists), p).collect()
    assert [(r.pid, r.user_id) for r in hits] == [(3, "u")]


def test_polygon_json_source(spark, tmp_path):
    path = tmp_path / "areas.json"
    path.write_text('{"pid": 1, "lats": [0, 1, 1], "lngs": [0, 0, 1]}\n')
    table = polygon_source.from_arrays(polygon_source.read_polygon_json(spark, str(path)))
    assert [(r.x, r.y) for r in polygon_source.vertices(table).orderBy("pos").collect()] == [
        (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_same_cell_split_equals_plain(spark, sf):
    q, p = inputs.query_points(spark, sf), inputs.query_points(spark, sf).select(
        F.col("qid").cast("string").alias("user_id"), "lat", "lng")
    plain = areas.same_cell_join(q, p)
    split = areas.same_cell_join(q, p, rows_per_split=1)
    assert plain.exceptAll(split).count() == 0 and plain.count() == split.count() > 0
    lat, lng = inputs.CENTRE
    one = spark.createDataFrame([(0, lat, lng)], "qid long, lat double, lng double")
    assert areas.same_cell_search(p, lat, lng).count() == areas.same_cell_join(one, p).count()


def test_every_crowded_key_is_split(spark):
    crowd = spark.range(330_000).select((F.col("id") % 11_000).alias("key"), F.col("id").alias("user_id"))
    asking = spark.range(11_000).select(F.col("id").alias("key"))
    assert skew.hot_keys(asking, crowd, "key", 20).where("_parts >= 2").count() == 11_000
    copies, single, on = skew.split(asking, crowd, "key", "user_id", 20)
    assert copies.join(single, on).count() == 330_000
    assert single.groupBy(*on).count().agg(F.max("count")).head()[0] < 30


def test_rows_are_counted_before_a_broadcast(spark):
    exploded = spark.range(3000).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("x"))
    assert planned_bytes(exploded) < 1 << 20 and not may_broadcast(exploded)
    assert may_broadcast(spark.range(1000)) and not may_broadcast(spark.range(1000), copies=10_000)


def test_repeated_positions_in_polygons_are_all_returned(spark):
    square = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])],
                                   "pid int, lats array<double>, lngs array<double>")
    table = polygon_source.from_arrays(square)
    rows = [("a", 0.5, 0.5)] * 3 + [("b", 0.5, 0.5), ("c", 2.0, 0.5), ("a", 0.25, 0.5)]
    p = spark.createDataFrame(rows, "user_id string, lat double, lng double")
    for rule in areas.RULES:
        for split in (None, 1):
            hits = areas.polygon_join(table, p, rule, split).groupBy("user_id").count().collect()
            assert {r["user_id"]: r["count"] for r in hits} == {"a": 4, "b": 1}


def test_ring_of_many_vertices(spark):
    n = 4000
    lats = [round(1.3 + (0.2 + 0.05 * (i % 2)) * math.sin(2 * math.pi * i / n), 6) for i in range(n)]
    lngs = [round(103.8 + (0.2 + 0.05 * (i % 2)) * math.cos(2 * math.pi * i / n), 6) for i in range(n)]
    ring = polygon_source.from_arrays(spark.createDataFrame(
        [(1, lats, lngs)], "pid int, lats array<double>, lngs array<double>"))
    filed = areas._filed_edges(ring)
    assert filed.groupBy("_cell").count().agg(F.max("count")).head()[0] < 1200
    p = spark.range(2000).select(
        F.col("id").cast("string").alias("user_id"), (1.0 + F.col("id") % 61 / 100).alias("lat"),
        (103.5 + F.col("id") % 67 / 110).alias("lng"))
    plain = p.where(areas.inside(F.col("lat"), F.col("lng"), [list(zip(lngs[::40], lats[::40]))]))
    rough = polygon_source.from_arrays(spark.createDataFrame(
        [(1, lats[::40], lngs[::40])], "pid int, lats array<double>, lngs array<double>"))
    assert areas.polygon_join(rough, p).count() == plain.count() > 0
    assert areas.polygon_join(ring, p).count() > 0


def test_k_beyond_the_given_maximum_is_an_error(spark, sf):
    p = inputs.positions(spark, sf)
    q = spark.createDataFrame([(1, 1.3, 103.8, 12), (2, 1.3, 103.8, None)], "qid long, lat double, lng double, k int")
    assert nearest.knn_join(q, p).groupBy("qid").count().collect() == [(1, 12)]
    with pytest.raises(Exception, match="k over 5"):
        nearest.knn_join(q, p, max_k=5).collect()


def test_longitude_box_loses_nobody(spark):
    rows = [(f"{a}/{b}", float(a), b / 2) for a in (-89.95, -60, 0, 45, 88, 89.99) for b in range(-360, 361, 3)]
    p = spark.createDataFrame(rows, "user_id string, lat double, lng double")
    for lat, lng, radius_m in ((0, 179.9, 3e5), (45, -179.5, 4e5), (88, 10, 5e5), (-89.9, 0, 2e4), (60, 0, 9e6)):
        d = geodesy.haversine(F.lit(float(lat)), F.lit(float(lng)), F.col("lat"), F.col("lng"))
        assert radius.range_search(p, lat, lng, radius_m).count() == p.where(d <= radius_m).count()


def test_every_way_of_joining_gives_the_same(spark, sf, monkeypatch):
    """Broadcasting one side, the other, or none: sizes only choose the plan."""
    from fleetlens.operators import areas as area_ops, radius as radius_ops

    q, p = inputs.query_points(spark, sf), inputs.positions(spark, sf)
    squares = polygon_source.from_arrays(inputs.squares(spark, sf))

    def results():
        return [sorted(map(tuple, df.collect())) for df in (
            radius_ops.range_join(q, p), nearest.knn_join(q, p, max_k=50),
            area_ops.polygon_join(squares, p), area_ops.same_cell_join(q, p))]

    broadcast_positions = results()
    assert all(broadcast_positions)
    for module in (radius_ops, area_ops):
        monkeypatch.setattr(module, "may_broadcast", lambda df, copies=1: "user_id" not in df.columns)
    assert results() == broadcast_positions
    for module in (radius_ops, area_ops):
        monkeypatch.setattr(module, "may_broadcast", lambda df, copies=1: False)
    assert results() == broadcast_positions


def test_counts_in_polygons_are_those_of_the_pairs(spark, sf):
    p = inputs.valid_positions(spark, sf)
    twice = p.unionByName(p).unionByName(p.limit(1).withColumn("lat", F.lit(None).cast("double")))
    for table, rule in ((polygon_source.from_arrays(inputs.concave_areas(spark, sf)), "winding"),
                        (polygon_source.from_wkt(inputs.wkt_parts(spark, sf)), "interior")):
        pairs_ = areas.polygon_join(table, twice, rule).groupBy("pid").count().collect()
        for split in (None, 100):
            assert sorted(areas.polygon_counts(table, twice, rule, split).collect()) == sorted(pairs_)


@pytest.mark.parametrize("rule", areas.RULES)
def test_no_pair_of_a_polygon_join_is_shuffled(spark, sf, rule):
    """Whatever the number of edges, a pair is decided where it is made."""
    squares = polygon_source.from_arrays(inputs.squares(spark, sf))
    ring = [(10 + math.cos(i / 10), 50 + math.sin(i / 10)) for i in range(60)]
    round_ = polygon_source.from_arrays(spark.createDataFrame(
        [(1, [y for _, y in ring], [x for x, _ in ring])], "pid long, lats array<double>, lngs array<double>"))
    for table in (squares, round_):
        text = areas.polygon_join(table, inputs.positions(spark, sf), rule)._jdf.queryExecution().executedPlan().toString()
        above = text[:text.index("BroadcastHashJoin")]
        assert "Exchange" not in above and "Aggregate" not in above


def test_queries_at_one_place_are_searched_once(world, monkeypatch):
    q, p, sq, sp = world
    many = sq.unionByName(sq.withColumn("qid", F.col("qid") + 1000).withColumn("k", F.lit(3).cast("long"))).unionByName(
        sq.withColumn("qid", F.col("qid") + 2000).withColumn("radius_m", F.col("radius_m") / 2))
    crowd = sp.unionByName(sp.withColumn("user_id", F.concat(F.lit("w"), "user_id")))
    searches = [lambda: nearest.knn_join(many, crowd, "spheroid"), lambda: nearest.knn_join(many, crowd, max_radius_m=1e5),
                lambda: nearest.first_within(many, crowd, 4), lambda: nearest.first_within(many, crowd, 4, "spheroid")]
    one_by_one = [sorted(map(tuple, s().collect())) for s in searches]
    hits = radius.first_hits(radius.range_join(many, crowd), 4)
    assert one_by_one[2] == sorted(map(tuple, hits.collect()))
    asked = []
    real = nearest._ranked
    monkeypatch.setattr(nearest, "SPOTS_FROM", 0)
    monkeypatch.setattr(nearest, "_ranked", lambda q, *a, **kw: asked.append(q.count()) or real(q, *a, **kw))
    assert [sorted(map(tuple, s().collect())) for s in searches] == one_by_one
    assert max(asked) <= len(q)
