"""Trace files: CSV with a header, columns found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.schemas import TRACE


def read_trace_csv(spark: SparkSession, path: str, schema: T.StructType = TRACE) -> DataFrame:
    """Columns by the names in the header, in any order; columns that are not in ``schema`` are
    left out, ones that the file lacks and malformed numbers are null.

    Only the first line is read to learn the names: all columns are text until cast.
    """
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    there = {c.strip().lower(): c for c in text.columns}
    return text.select(*[
        F.col(f"`{there[f.name.lower()]}`").try_cast(f.dataType).alias(f.name)
        if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def write_trace_csv(trace: DataFrame, path: str) -> None:
    trace.write.mode("overwrite").option("header", True).csv(path)
