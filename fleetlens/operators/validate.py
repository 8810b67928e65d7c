"""Normalising trace rows and checking pings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import pings as rules


def with_required_trace_fields(trace: DataFrame) -> DataFrame:
    """Drop trace rows without an id, a latitude or a longitude."""
    return trace.where((F.col("trj_id") != "") & F.col("rawlat").isNotNull()
                       & F.col("rawlng").isNotNull())


def normalize_trace(trace: DataFrame, fallback: str | None = None) -> DataFrame:
    """Trace rows to pings: km/h, epoch milliseconds, service type, constant status.

    ``fallback="BIKE"`` takes the two-way service rule. A missing time stamp becomes the
    arrival time.
    """
    if fallback not in (None, "BIKE"):
        raise ValueError(f"unknown fallback {fallback!r}")
    mode = F.col("driving_mode")
    service = rules.service_type(mode) if fallback is None else rules.service_type_binary(mode)
    return trace.select(
        "seq",
        F.col("trj_id").alias("user_id"),
        service.alias("service_type"),
        F.col("rawlat").alias("latitude"),
        F.col("rawlng").alias("longitude"),
        F.col("bearing").alias("heading"),
        (F.col("speed") * F.lit(rules.MS_TO_KMH)).alias("speed"),
        "accuracy",
        F.lit(rules.ON_TASK).alias("status"),
        F.coalesce(F.col("pingtimestamp") * 1000, F.col("ingest_ms")).alias("ts_ms"),
        "ingest_ms",
    )


# Broken rules by code. A null heading or speed breaks none.
RULES = {
    "user_id_blank": "user_id IS NULL OR NOT user_id RLIKE '\\\\S'",
    "service_type_blank": "service_type IS NULL OR NOT service_type RLIKE '\\\\S'",
    "latitude_missing": "latitude IS NULL",
    "latitude_range": "latitude NOT BETWEEN -90e0 AND 90e0",
    "longitude_missing": "longitude IS NULL",
    "longitude_range": "longitude NOT BETWEEN -180e0 AND 180e0",
    "heading_range": "heading NOT BETWEEN 0e0 AND 360e0",
    "speed_negative": "speed < 0e0",
}


def violations() -> Column:
    """Codes of the broken rules, empty for a valid ping."""
    codes = [f"CASE WHEN {broken} THEN '{code}' END" for code, broken in RULES.items()]
    return F.expr(f"array_compact(array({', '.join(codes)}))")


def is_valid() -> Column:
    """The same rules as one plain condition: no array is built for a ping that passes."""
    return F.expr(" AND ".join(f"NOT coalesce({broken}, false)" for broken in RULES.values()))


def with_violations(pings: DataFrame) -> DataFrame:
    return pings.withColumn("violations", violations())


def valid(pings: DataFrame) -> DataFrame:
    return pings.where(is_valid())


def split_valid(pings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid pings, and the rejected ones with their violation codes."""
    return valid(pings), with_violations(pings.where(~is_valid()))


def violation_summary(pings: DataFrame) -> DataFrame:
    """Broken rules with their number of pings."""
    return (
        with_violations(pings)
        .select(F.explode("violations").alias("violation"))
        .groupBy("violation").agg(F.count("*").alias("pings"))
    )


# What a ping must have to be applied.
REQUIRED = ("user_id", "latitude", "longitude", "ts_ms")


def producible(pings: DataFrame) -> DataFrame:
    """Pings a producer may send: those with a key."""
    return pings.where(F.col("user_id").isNotNull())


def consumable(pings: DataFrame) -> DataFrame:
    """Pings a consumer may apply: key, coordinates and time stamp present."""
    return pings.dropna(subset=list(REQUIRED))


def sanitize_ids(pings: DataFrame) -> DataFrame:
    return pings.withColumn("user_id", rules.clean_id(F.col("user_id")))


def id_collisions(pings: DataFrame) -> DataFrame:
    """Clean ids that stand for more than one rider, with the number of riders."""
    return (
        pings.select("user_id").distinct()
        .groupBy(rules.clean_id(F.col("user_id")).alias("clean_id"))
        .agg(F.count("*").alias("riders"))
        .where(F.col("riders") > 1)
    )


def parse_with_defaults(trace_text: DataFrame) -> DataFrame:
    """Text columns of a trace to numbers; missing ones become 0, accuracy 1."""
    defaults = {"rawlat": 0.0, "rawlng": 0.0, "speed": 0.0, "bearing": 0.0, "accuracy": 1.0}
    return trace_text.withColumns(
        {c: rules.number_or(F.col(c), d) for c, d in defaults.items()}
    )
