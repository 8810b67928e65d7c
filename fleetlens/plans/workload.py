"""Workload tables: seeded riders, updates of them, and search requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_riders(riders: DataFrame, trace: DataFrame) -> DataFrame:
    """One ping per rider number, each at a trace row of its own choice.

    ``riders`` has a number ``n``; trace rows are numbered 0.. in ``seq``. The choice is
    arithmetic, so a rerun seeds the same fleet.
    """
    rows = trace.agg(F.count("*")).scalar()
    pick = F.pmod(F.col("n") * 7919 + 13, rows)
    return (
        riders.select("n", pick.alias("seq"))
        .join(trace.select("seq", "trj_id", "rawlat", "rawlng", "speed"), "seq")
        .select(
            F.concat(F.lit("user_"), F.col("n").cast("string")).alias("user_id"),
            F.concat(F.col("trj_id"), F.lit("_v"), F.col("n").cast("string")).alias("vehicle"),
            F.col("rawlat").alias("latitude"), F.col("rawlng").alias("longitude"), "speed",
        )
    )


def update_batch(trace: DataFrame, riders: DataFrame) -> DataFrame:
    """One operation per trace row on a rider numbered 0..: nine writes to one read."""
    n = riders.agg(F.count("*")).scalar()
    target = F.pmod(F.col("seq") * 104729 + 7, n)
    return trace.select(
        "seq",
        F.concat(F.lit("user_"), target.cast("string")).alias("user_id"),
        F.when(F.col("seq") % 10 < 9, "write").otherwise("read").alias("op"),
        F.col("rawlat").alias("latitude"), F.col("rawlng").alias("longitude"),
    )


def query_workload(centres: DataFrame) -> DataFrame:
    """Search requests, a third each of polygon, range and nearest, one per centre.

    Radius 500..5000 m, k 10..50, and squares of 0.02 or 0.05 degrees to the north-east.
    """
    share = F.col("qid") % 100
    kind = F.when(share < 33, "pip").when(share < 66, "range").otherwise("knn")
    side = F.when(F.col("qid") % 2 == 0, 0.02).otherwise(0.05)
    return centres.withColumn("kind", kind).select(
        "qid", "kind", "lat", "lng",
        F.when(F.col("kind") == "range", F.col("radius_m")).alias("radius_m"),
        F.when(F.col("kind") == "knn", F.col("k").cast("long")).alias("k"),
        F.when(F.col("kind") == "pip", F.round(F.col("lat") + side, 5)).alias("max_lat"),
        F.when(F.col("kind") == "pip", F.round(F.col("lng") + side, 5)).alias("max_lng"),
    )
