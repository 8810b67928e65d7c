"""Splitting of crowded join keys.

In a cell join one task compares every query of a cell with every position of it, so a
cell with a third of all positions is too much for one task however few bytes it has.
The positions are counted per cell (a partial aggregate), and all crowded cells get
sub-cells: a position falls into one of them, a query is copied to all. Every pair still
meets exactly once. A crowd of queries in a cell is many bytes in one shuffle partition,
which AQE's skew join splits without help.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import may_broadcast, stored

ROWS_PER_SPLIT = 20_000
# A sub-cell may meet more positions than that where few queries do: up to
# rows_per_split * QUERIES_PER_SPLIT comparisons.
QUERIES_PER_SPLIT = 1000
SPLITS_PER_CORE = 8


def hot_keys(others: DataFrame, crowd: DataFrame, key: str, rows_per_split: int) -> DataFrame:
    """Every key with more than ``rows_per_split`` rows that ``others`` has too, and its number
    of sub-keys: at least two, as many as its comparisons ask for, and no more than keep all
    cores busy, so that queries are not copied without need."""
    cores = crowd.sparkSession.sparkContext.defaultParallelism
    crowded = crowd.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_split)
    asked = others.groupBy(key).agg(F.count("*").alias("_queries"))
    by_rows = F.ceil(F.col("_rows") / F.lit(float(rows_per_split)))
    by_pairs = F.ceil(F.col("_rows") * F.col("_queries") / F.lit(float(rows_per_split * QUERIES_PER_SPLIT)))
    most = F.lit(cores * SPLITS_PER_CORE).cast("long")
    parts = F.greatest(F.lit(2).cast("long"), F.least(by_rows, by_pairs, most))
    return crowded.join(asked, key).select(key, parts.alias("_parts"))


def split(
    others: DataFrame, crowd: DataFrame, key: str, crowd_id: str,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a ``_sub`` column, and the names of the columns to join on.

    The table of crowded keys is joined without a hint: AQE broadcasts it if it turns out
    small, and splits skewed partitions otherwise. The sub-key of a row comes from its id, so a
    recomputed task repeats it.
    """
    hot = hot_keys(others, crowd, key, rows_per_split)
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    copies = others.join(hot, key, "left").withColumn(
        "_sub", F.explode_outer(F.sequence(F.lit(0).cast("long"), parts - 1))
    )
    single = crowd.join(hot, key, "left").withColumn("_sub", F.pmod(F.xxhash64(crowd_id), parts))
    return copies.drop("_parts"), single.drop("_parts"), [key, "_sub"]


# Rows of the held side that a task keeps in memory, and of the asking side that it gets.
HELD_PER_PART = 200_000
ASKED_PER_PART = 500_000
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def shares(asking: DataFrame, held: DataFrame, key: str, rows_per_split: int | None = None) -> DataFrame:
    """``key, _asked_parts, _held_parts``: into how many parts the rows of a key are divided on either
    side, each being copied to all parts of the other. ``held`` has the rows of the other side counted,
    ``_held``. The fewer rows are copied more often: so many times that they stay fewer than the others."""
    rows = F.col("_held")
    asked = F.col("_asked")
    most = F.lit(float(min(HELD_PER_PART, (rows_per_split or HELD_PER_PART) * QUERIES_PER_SPLIT)))
    parts = asking.groupBy(key).agg(F.count("*").alias("_asked")).join(held, key).select(
        key, F.least(F.ceil(asked / F.lit(float(ASKED_PER_PART))), F.ceil(asked / rows)).alias("_asked_parts"),
        F.ceil(rows / most).alias("_held_parts"))
    return stored(parts, "shares")


def dealt(df: DataFrame, parts: DataFrame, key: str, id: str, own: str, other: str) -> DataFrame:
    """``df`` with ``_sub``, shuffled by ``key`` and ``_sub``: a row goes to the part of its ``id`` out of
    ``own`` parts, once for each of the ``other`` parts. ``_first`` marks one of these copies."""
    parts = F.broadcast(parts) if may_broadcast(parts) else parts
    asking = own == "_asked_parts"
    at = F.pmod(F.xxhash64(id), F.col(own))
    copy = F.col("_copy")
    sub = at * F.col(other) + copy if asking else copy * F.col(own) + at
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (
        df.join(parts, key).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .withColumn("_sub", sub).withColumn("_first", copy == 0).drop("_copy", "_asked_parts", "_held_parts")
        .repartition(int(n), key, "_sub")
    )


@contextmanager
def kept_together(spark: SparkSession) -> Iterator[None]:
    """While rows lie together by some of the columns of a join, the join shuffles them no more."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)
