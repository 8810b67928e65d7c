"""What the operators share: tables, stored intermediate results, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_dir

# A key is hot if it has more than one row in HOT_SHARE; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost
    executor costs only its own tasks."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def private(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def commonest(counted: DataFrame, count: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``counted``: those from some count on. The bound on the count
    comes from a histogram of its logarithm, so only that and the rows asked for are gathered,
    not the largest of every task."""
    step = F.floor(F.log2(count) * 16)
    seen, least = 0, None
    for row in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        seen += row["n"]
        if seen > most:
            break
        least = row["step"]
    return counted.filter(F.lit(False) if least is None else step >= least)


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int,
                how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed``, which has one row per key and in ``n`` the key's rows.

    Keys with more than ``total / HOT_SHARE`` rows, fewer than HOT_SHARE of them by
    counting, are broadcast, so no task gathers the rows of a hot key. All other keys
    are joined by shuffle.
    """
    limit = max(1, total // HOT_SHARE)
    hot = keyed.filter(F.col("n") > limit)
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    marked = rows.join(marks, keys, "left")
    few = marked.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
    return few.join(F.broadcast(hot), keys).unionByName(
        rest.join(keyed.filter(F.col("n") <= limit), keys, how)
    )
