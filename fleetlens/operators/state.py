"""Latest state per rider, upserts and the time-limited status.

All reductions are per-column ``max_by``/``min_by`` aggregates with map-side combining, so a
rider with a third of all pings costs one partial row per task. With numeric columns alone
they are hash aggregates. The service type and the documents are text, which Spark aggregates
after a sort within each task; the shuffle is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.pings import STATUS_TTL_MS, clean_id, document

ORDERS = ("seq", "ts_ms")

# Columns every ping overwrites: name in the position table, name in the ping.
LAST_WRITE = {
    "lat": "latitude", "lng": "longitude", "speed": "speed", "accuracy": "accuracy",
    "ts_ms": "ts_ms", "updated_ms": "ingest_ms", "seq": "seq",
}

REDUCED = ("user_id", "lat", "lng", "speed", "accuracy", "service_type",
           "ts_ms", "updated_ms", "seq", "first_seq")


def _order(order_by: str) -> Column:
    """Arrival order, or event time with arrival order among equals."""
    if order_by not in ORDERS:
        raise ValueError(f"order_by must be one of {ORDERS}, not {order_by!r}")
    return F.col("seq") if order_by == "seq" else F.struct("ts_ms", "seq")


def reduce_pings(pings: DataFrame, order_by: str = "seq") -> DataFrame:
    """Pings to one row per rider: last-write-wins columns and the first service type.

    The result has the layout of :func:`merge_reduced`, so reductions of parts of a
    stream can be reduced again.
    """
    key = _order(order_by)
    return (
        pings.groupBy("user_id")
        .agg(
            *[F.max_by(F.col(src), key).alias(dst) for dst, src in LAST_WRITE.items()],
            F.min_by("service_type", "seq").alias("service_type"),
            F.min("seq").alias("first_seq"),
        )
        .select(*REDUCED)
    )


def merge_reduced(parts: DataFrame, order_by: str = "seq") -> DataFrame:
    """Several reduced rows per rider to one."""
    key = _order(order_by)
    return (
        parts.groupBy("user_id")
        .agg(
            *[F.max_by(F.col(c), key).alias(c) for c in LAST_WRITE],
            F.min_by("service_type", "first_seq").alias("service_type"),
            F.min("first_seq").alias("first_seq"),
        )
        .select(*REDUCED)
    )


def latest_positions(pings: DataFrame, order_by: str = "seq", sanitize: bool = False) -> DataFrame:
    """Current position per rider: the last ping in arrival order by default."""
    df = pings.withColumn("user_id", clean_id(F.col("user_id"))) if sanitize else pings
    key = _order(order_by)
    return df.groupBy("user_id").agg(
        *[F.max_by(F.col(src), key).alias(dst) for dst, src in LAST_WRITE.items()]
    )


def upsert_positions(pings: DataFrame, order_by: str = "seq") -> DataFrame:
    """Position table after all pings: as latest, but the service type of the first ping."""
    return reduce_pings(pings, order_by).drop("first_seq")


def upsert_merge(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Snapshot after a batch of pings, in arrival order whatever the order of batches.

    A rider moves only if the batch has a later ping than the snapshot, so a batch may come
    late or twice. ``snapshot`` is made by :func:`reduce_pings`; one without ``first_seq``
    keeps the service types that it has. Both sides have one row per rider, so the outer
    join has no crowded key. The result has the columns of ``snapshot``.
    """
    s, d = snapshot.alias("s"), reduce_pings(delta).alias("d")
    later = F.col("s.seq").isNull() | (F.col("d.seq") > F.col("s.seq"))
    first = F.col("s.seq").isNull()
    if "first_seq" in snapshot.columns:
        first = first | (F.col("d.first_seq") < F.col("s.first_seq"))
    take = {c: later for c in LAST_WRITE} | {"service_type": first, "first_seq": first}
    return s.join(d, "user_id", "full_outer").select(*[
        F.when(take[c], F.col(f"d.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in take
        else F.col(c)
        for c in snapshot.columns
    ])


def point_lookup(positions: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Rows of the riders in ``user_ids``."""
    return positions.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")


def status_snapshot(pings: DataFrame, ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """Last status document per rider and the time it expires; each write renews it."""
    return (
        pings.groupBy("user_id")
        .agg(F.max_by(document(), "seq").alias("doc"), F.max_by("ingest_ms", "seq").alias("last_ms"))
        .select("user_id", F.to_json("doc").alias("document"),
                (F.col("last_ms") + ttl_ms).alias("expires_at"))
    )


def active_status(pings: DataFrame, as_of_ms: Column | int, ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """Riders whose status is alive at ``as_of_ms``: last write less than the TTL ago."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    return (
        pings.where(F.col("ingest_ms") <= as_of)
        .groupBy("user_id").agg(F.max_by("ingest_ms", "seq").alias("last_ms"))
        .where(as_of - F.col("last_ms") < ttl_ms)
        .select("user_id", "last_ms", (F.col("last_ms") + ttl_ms).alias("expires_at"))
    )


def active_only(positions: DataFrame, active: DataFrame) -> DataFrame:
    """Positions of riders with a living status."""
    return positions.join(active.select("user_id"), "user_id", "left_semi")


def rider_documents(records: DataFrame) -> DataFrame:
    """Last document per ``trj_id`` from decoded map records; the whole document is replaced."""
    doc = F.struct(*[c for c in records.columns if c not in ("seq", "parse_errors")])
    return (
        records.groupBy("trj_id").agg(F.max_by(doc, "seq").alias("doc"))
        .select(F.concat(F.lit("rider:"), "trj_id").alias("doc_key"), "doc.*")
    )


def hits_from_documents(docs: DataFrame) -> DataFrame:
    """Rider documents as search hits; a document without ``dist`` has distance zero."""
    dist = F.coalesce(F.col("dist"), F.lit(0.0)) if "dist" in docs.columns else F.lit(0.0)
    return docs.select(
        F.col("trj_id").alias("user_id"),
        F.col("rawlat").try_cast("double").alias("latitude"),
        F.col("rawlng").try_cast("double").alias("longitude"),
        dist.alias("distance_meter"), "cell", F.col("driving_mode").alias("status"),
    )
