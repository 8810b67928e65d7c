"""Streaming jobs. Each writes one folder per micro-batch and can be replayed.

A batch folder is overwritten when its batch is repeated after a failure, so results
are exactly-once. Upserts append one reduced row per rider and batch: a write costs as
much as the batch, not as much as the table, and a reader merges the reduced rows with
the same aggregate. ``compact`` merges old batches into a base table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.pings import STATUS_TTL_MS, lag_ms
from fleetlens.operators import metrics
from fleetlens.operators.state import active_status, merge_reduced, reduce_pings
from fleetlens.operators.validate import consumable
from fleetlens.schemas import PING
from fleetlens.sources.topics import decode_map, decode_numeric, marked_poison, split_poison

Reduce = Callable[[DataFrame], DataFrame]
STATE = "spark.sql.streaming.stateStore"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on executor disks with checkpoints, not in the heap. A batch writes
    what it changed; whole snapshots are made beside the batches."""
    spark.conf.set(f"{STATE}.providerClass", ROCKSDB)
    spark.conf.set(f"{STATE}.rocksdb.changelogCheckpointing.enabled", "true")


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    reduce: Reduce | None = None,
    mode: str = "append",
    poll: str | None = None,
    divide_by: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Write ``stream`` to ``path/batch=<id>``, each batch passed through ``reduce``.

    ``divide_by`` names a column by whose values a batch is divided into folders; they are
    written in one pass and count as one. ``poll`` is a processing-time interval such as ``1 second``; without it the job takes
    what is there and ends.

    ``partitions`` divides a job's state, at least into one part per core; without it the session's
    setting does. Every part is opened and committed in every batch, however little is in it, so
    there should be no more than a batch has work for. A checkpoint keeps its number.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        out = reduce(batch) if reduce else batch
        writer = out.write.mode("overwrite")
        (writer.partitionBy(divide_by) if divide_by else writer).parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    job = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(**trigger)
    )
    if partitions is None:
        return job.start()
    # a job keeps the settings of the moment it starts
    others = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(max(partitions, spark.sparkContext.defaultParallelism)))
    try:
        return job.start()
    finally:
        spark.conf.set(PARTITIONS, others)


def read_batches(spark: SparkSession, path: str, schema: str | None = None,
                 after: int | None = None) -> DataFrame:
    """All batches of a job, with their number in ``batch``; none if the job wrote nothing yet.

    ``schema`` declares the columns; without it they are those of the files, which must exist.
    """
    try:
        # ``batch`` comes from the folder names; job lists have none and get null
        reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch int")
        rows = reader.parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch int")
    return rows if after is None else rows.where(F.col("batch") > after)


# ---- ingest -----------------------------------------------------------------------


def ingest(decoded: DataFrame) -> DataFrame:
    """Pings of a stream that can be applied."""
    return consumable(split_poison(decoded)[0])


def quarantined(decoded: DataFrame) -> DataFrame:
    """Messages of a stream that are no pings."""
    return split_poison(decoded)[1]


def start_divided(decoded: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Pings and poison of one pass over a stream, as two tables under ``path``. A batch that
    failed half written is written again as a whole, both halves."""
    return start(marked_poison(decoded), path, checkpoint, divide_by="poison", **kw)


DIVIDED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PING) + ", value string, poison boolean"


def applied(spark: SparkSession, path: str) -> DataFrame:
    """The pings of a :func:`start_divided` job."""
    return read_batches(spark, path, DIVIDED).where("not poison").select(*PING.fieldNames())


def put_aside(spark: SparkSession, path: str) -> DataFrame:
    """The poison messages of a :func:`start_divided` job."""
    return read_batches(spark, path, DIVIDED).where("poison").select("seq", "value", "ingest_ms")


def decoded_maps(messages: DataFrame) -> DataFrame:
    """String-map messages with numbers in place of text."""
    return decode_numeric(decode_map(messages))


# ---- positions --------------------------------------------------------------------


PARTS = ("user_id string, lat double, lng double, speed double, accuracy double, service_type string, "
         "ts_ms long, updated_ms long, seq long, first_seq long")


def start_upserts(pings: DataFrame, path: str, checkpoint: str, order_by: str = "seq", **kw) -> StreamingQuery:
    """Stateless upsert: one reduced row per rider and batch, the last in arrival order or, with
    ``order_by="ts_ms"``, in event time. Readers must ask for the same order."""
    return start(pings, path, checkpoint, reduce=partial(reduce_pings, order_by=order_by), **kw)


BASES = "base string, upto int"


def last_base(spark: SparkSession, path: str) -> tuple[str | None, int | None]:
    """The newest base of a job and the last batch in it, from the list beside its output."""
    row = read_batches(spark, f"{path}-bases", BASES).orderBy(F.desc("upto")).select("base", "upto").head()
    return (row["base"], row["upto"]) if row else (None, None)


def compact_to(spark: SparkSession, path: str, upto: int, order_by: str = "seq") -> str:
    """Merge the batches up to ``upto`` and the newest base into a new base, and list it.

    The list is only appended to, after the base is whole: readers see the old base or the
    new one. Batches in a base are read no more, and their folders may be deleted.
    """
    base, done = last_base(spark, path)
    out = f"{path}-base/upto={upto}"
    compact(spark, path, out, upto, base, done, order_by)
    spark.createDataFrame([(out, upto)], BASES).coalesce(1).write.mode("append").parquet(f"{path}-bases")
    return out


def current_positions(spark: SparkSession, path: str, base: str | None = None,
                      upto: int | None = None, order_by: str = "seq") -> DataFrame:
    """Position table after all batches, over the newest base, or a given one that holds the
    batches up to ``upto``."""
    if base is None and upto is None:
        base, upto = last_base(spark, path)
    parts = read_batches(spark, path, PARTS, after=upto).drop("batch")
    if base is not None:
        parts = spark.read.schema(PARTS).parquet(base).unionByName(parts)
    return merge_reduced(parts, order_by)


def compact(spark: SparkSession, path: str, out: str, upto: int,
            base: str | None = None, base_upto: int | None = None, order_by: str = "seq") -> None:
    """Merge the batches up to ``upto`` (and an older base) into the new base ``out``."""
    parts = read_batches(spark, path, PARTS, after=base_upto).where(F.col("batch") <= upto).drop("batch")
    if base is not None:
        parts = spark.read.schema(PARTS).parquet(base).unionByName(parts)
    merge_reduced(parts, order_by).write.mode("overwrite").parquet(out)


def start_latest(pings: DataFrame, path: str, checkpoint: str, order_by: str = "seq", **kw) -> StreamingQuery:
    """Stateful form: the state store holds one row per rider, changed rows are written."""
    return start(reduce_pings(pings, order_by), path, checkpoint, mode="update", **kw)


# ---- status with a time limit ------------------------------------------------------


def writes(batch: DataFrame) -> DataFrame:
    """When each rider of a batch wrote: what it takes to answer for any moment, past ones too."""
    return batch.groupBy("user_id", "ingest_ms").agg(F.max("seq").alias("seq"))


WRITES = "user_id string, ingest_ms long, seq long"


def start_status(pings: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    return start(pings, path, checkpoint, reduce=writes, **kw)


def active_at(spark: SparkSession, path: str, as_of_ms, ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """Riders of a status job whose last write at or before ``as_of_ms`` is less than the TTL
    before it."""
    return active_status(read_batches(spark, path, WRITES), as_of_ms, ttl_ms)


def status_periods(pings: DataFrame, delay: str = "1 minute",
                   ttl: str = "30 minutes") -> DataFrame:
    """Periods in which a rider's status was alive: each write extends the TTL.

    In append mode a period is emitted, and its state dropped, once it has expired.
    """
    at = F.timestamp_millis("ingest_ms")
    live = pings.withColumn("_at", at)
    if live.isStreaming:
        live = live.withWatermark("_at", delay)
    return (
        live.groupBy("user_id", F.session_window("_at", ttl).alias("w"))
        .agg(F.count("*").alias("writes"))
        .select("user_id", F.unix_millis("w.start").alias("from_ms"),
                F.unix_millis("w.end").alias("expires_at"), "writes")
    )


def status_expiry(pings: DataFrame, delay: str = "1 minute", ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """``user_id, last_ms, expired_ms``: one row whenever a rider has not written for the limit,
    whether or not it ever writes again.

    A status is a session of writes less than the limit apart. The state holds the open ones; one
    is told, and dropped, when the stream's time, ``delay`` behind the latest write, has passed its
    end. Writes whose own time limit has passed by then are ignored.
    """
    return status_periods(pings, delay, f"{ttl_ms} milliseconds").select(
        "user_id", (F.col("expires_at") - F.lit(ttl_ms)).alias("last_ms"), F.col("expires_at").alias("expired_ms"))


# ---- rates over overlapping windows ---------------------------------------------------


def _panes(classified: DataFrame, width_ms: int, slide_ms: int, delay: str, aggregates: list) -> DataFrame:
    pane = f"{math.gcd(width_ms, slide_ms)} milliseconds"
    timed = classified.withColumn("_at", F.timestamp_millis("ts_ms"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", delay)
    return timed.groupBy("application", "class", F.window("_at", pane).alias("_pane")).agg(*aggregates)


def sliding(classified: DataFrame, width_ms: int, slide_ms: int, delay: str, aggregates: list) -> DataFrame:
    """Sums of ``aggregates``, counts with a name each, over overlapping windows per application
    and class, with ``window_ms``.

    Two stateful steps: requests are counted per pane, and a pane that is complete is added to
    the windows that hold it. In append mode a window is emitted once, when the watermark has
    passed its end; so state holds counts of open panes and windows, not requests.
    """
    panes = _panes(classified, width_ms, slide_ms, delay, aggregates)
    names = [c for c in panes.columns if c not in ("application", "class", "_pane")]
    windows = F.window(F.window_time("_pane"), f"{width_ms} milliseconds", f"{slide_ms} milliseconds")
    return (
        panes.groupBy("application", "class", windows.alias("_w")).agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names])
        .select("application", "class", F.unix_millis("_w.start").alias("window_ms"), *[F.col(f"`{n}`") for n in names])
    )


def sliding_throughput(classified: DataFrame, width_ms: int, slide_ms: int, delay: str = "1 minute") -> DataFrame:
    """Requests per second over overlapping windows."""
    counts = sliding(classified, width_ms, slide_ms, delay, [F.count("*").alias("n")])
    return counts.select("application", "class", "window_ms", (F.col("n") / F.lit(width_ms / 1000.0)).alias("rps"))


def sliding_latency(classified: DataFrame, width_ms: int, slide_ms: int, delay: str = "1 minute",
                    bounds: tuple[float, ...] = metrics.LATENCY_BOUNDS_MS) -> DataFrame:
    """p95 and p99 of the latency over overlapping windows."""
    counts = sliding(classified, width_ms, slide_ms, delay, metrics.bucket_counts(F.col("duration_ms"), bounds))
    return metrics.quantiles(counts, ["application", "class", "window_ms"], bounds)


# ---- freshness --------------------------------------------------------------------


def freshness(pings: DataFrame, delay: str = "10 minutes", width: str = "1 minute",
              bounds: tuple[int, ...] = metrics.FRESHNESS_BOUNDS_MS) -> DataFrame:
    """Lag histogram per arrival window; windows older than the watermark are dropped from state."""
    lagged = (
        pings.withColumn("lag_ms", lag_ms(F.col("ts_ms"), F.col("ingest_ms")))
        .where(F.col("lag_ms") >= 0)
        .withColumn("_at", F.timestamp_millis("ingest_ms"))
    )
    if lagged.isStreaming:
        lagged = lagged.withWatermark("_at", delay)
    return (
        lagged.groupBy(F.window("_at", width).alias("w"))
        .agg(*metrics.bucket_counts(F.col("lag_ms"), bounds))
        .select(F.unix_millis("w.start").alias("window_ms"),
                *[f"le_{b}" for b in bounds], "n")
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """Last state of every window of an update-mode job."""
    rows = read_batches(spark, path)
    values = [c for c in rows.columns if c not in ("window_ms", "batch")]
    return rows.groupBy("window_ms").agg(*[F.max_by(c, "batch").alias(c) for c in values])
