"""Exact duplicates by skew-safe combining: local, salted, then global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import HOT_SHARE, join_by_key, private, stored, text_or_empty

SALTS = 64
SPACES = r"[\x20\x09-\x0D]+"


def normal_text(column: str) -> Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normal texts are, byte by byte; the smallest id of equal texts
    stays. Rows are grouped by digest *and* content at every stage: first within each map
    task, then by (digest, salt), the salt being the task's number, then the winners of the
    salts of a hot digest. Only digests with more than one row in HOT_SHARE are salted.

    Null texts equal empty ones. A row without an id never displaces one with an id; if no
    row of a group has one, keep_id is null and all of them are kept. Repeated rows (same id
    and text) all count and are all ``kept``, as they name the same document;
    ``deduplicate`` leaves one of them. An empty table gives an empty result; other columns
    of ``docs`` are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normal_text(text_col).alias("_text"))
    rows = rows.select("_id", "_text", F.sha2("_text", 256).alias("_digest"))
    # _check tells texts apart that have the same digest, after their contents were compared
    ids = stored(rows.select("_id", "_digest", F.xxhash64("_text").alias("_check")), "dedup-ids")
    total = ids.count()
    limit = max(1, total // HOT_SHARE)
    hot = stored(ids.groupBy("_digest").agg(F.count("*").alias("n"))
                 .filter(F.col("n") > limit), "dedup-hot")

    salted = (
        rows.join(F.broadcast(hot.select("_digest", F.lit(True).alias("_hot"))), "_digest", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.spark_partition_id() % salts).otherwise(-1))
    )
    # the partial aggregation is the local stage, the final one merges a salt's rows
    merged = salted.groupBy("_digest", "_salt", "_text").agg(
        F.min("_id").alias("_keep"), F.count("*").alias("n"))
    winners = stored(merged.select(
        "_digest", "_salt", "_keep", "n", F.xxhash64("_text").alias("_check"),
        F.when(F.col("_salt") >= 0, F.col("_text")).alias("_text")), "dedup-winners")
    final = winners.filter("_salt < 0").select("_digest", "_check", "_keep", "n").unionByName(
        winners.filter("_salt >= 0").groupBy("_digest", "_check", "_text")
        .agg(F.min("_keep").alias("_keep"), F.sum("n").alias("n")).drop("_text"))
    return join_by_key(ids, final, ["_digest", "_check"], total).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text occurs at no smaller id, with all columns; of repeated
    rows one. Edge cases as in ``exact_duplicates``."""
    keep, sha, own = (private(docs, n) for n in ("_keep", "_sha", "_own"))
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(
        F.col(id_col).alias(keep), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(own, F.sha2(normal_text(text_col), 256))
    joined = marked.join(kept, F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(own) == F.col(sha)))
    return joined.dropDuplicates([id_col, own]).select(*docs.columns)
