"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import nearest, radius, state
from fleetlens.plans import inputs
from fleetlens.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["range_join", "knn_join", "pip_join", "same_cell", "kpi_bands",
                                  "queries_without_hits", "seed_riders", "point_lookup"])
def test_no_join_compares_all_pairs(name, spark, sf):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


def test_latest_state_stays_in_hash_aggregation(spark, sf):
    text = plan(state.latest_positions(inputs.valid_pings(spark, sf)))
    assert "HashAggregate" in text and "SortAggregate" not in text
    # The text of the service type takes a sort within the tasks, but no further shuffle.
    for df in (state.latest_positions, state.upsert_positions):
        assert plan(df(inputs.valid_pings(spark, sf))).count("Exchange") == 1


def test_large_knn_join_is_shuffled_and_cut_early(spark, sf):
    df = nearest.knn_join(inputs.query_points(spark, sf), inputs.positions(spark, sf),
                          max_k=50, rows_per_split=1000)
    text = plan(df)
    assert "WindowGroupLimit" in text and "hashpartitioning(_cell" in text


def test_centre_search_pushes_its_box_down(spark, sf, tmp_path):
    tables.write_positions(state.upsert_positions(inputs.valid_pings(spark, sf)), str(tmp_path / "p"))
    stored = tables.read_positions(spark, str(tmp_path / "p"))
    hits = radius.range_search(stored, *inputs.CENTRE, 3000.0).select("user_id", "distance_meter")
    text = plan(hits)
    assert "GreaterThanOrEqual(lat" in text and "LessThanOrEqual(lat" in text
    assert "ReadSchema: struct<user_id:string,lat:double,lng:double>" in text


def test_an_indexed_snapshot_is_read_by_tiles_in_reach(spark, tmp_path):
    world = spark.range(4000).selectExpr(
        "concat('u', id) AS user_id", "CAST(id * 37 % 179 - 89 AS double) AS lat", "CAST(id * 53 % 359 - 179 AS double) AS lng",
        "0D AS speed", "0D AS accuracy", "'TAXI' AS service_type", "0L AS ts_ms", "0L AS updated_ms", "id AS seq")
    nowhere = world.limit(3).withColumn("lat", F.lit(None).cast("double"))
    tables.write_indexed(world.unionByName(nowhere), str(tmp_path / "p"))
    snapshot = tables.read_indexed(spark, str(tmp_path / "p"))
    assert snapshot.count() == 4000
    centres = spark.createDataFrame([(1, 10.0, 20.0, 150_000.0), (2, -89.9, 0.0, 200_000.0), (3, 0.0, 179.99, 90_000.0)],
                                    "qid long, lat double, lng double, radius_m double")
    near = tables.within_reach(snapshot, centres)
    assert "dynamicpruning" in plan(near.select("user_id"))
    assert near.count() < 400
    for metric in ("sphere", "spheroid"):
        hits = radius.range_join(centres, tables.within_reach(snapshot, centres, metric), metric)
        assert sorted(hits.collect()) == sorted(radius.range_join(centres, world, metric).collect())
    assert tables.within_reach(snapshot, centres.where("false")).count() == 0


def test_a_text_is_parsed_once(spark, sf):
    """A filter on the parsed rings, or one that an explode asks for, brings no copy of the parser."""
    for name in ("rejected_areas", "polygon_from_wkt"):
        text = plan(entry.queries()[name](spark, sf))
        assert text.count("MULTIPOLYGON\\") == 1, name
