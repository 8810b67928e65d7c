"""Ping topics: keyed messages with a JSON value, as a typed record or a string map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.hexcell import hex_cell
from fleetlens.functions.pings import document, lng_lat_text, text_or_null_word
from fleetlens.operators.validate import REQUIRED, producible
from fleetlens.schemas import MAP_FIELDS, PING, PING_JSON, TOPIC

FORMATS = ("kafka", "json", "parquet")
CORRUPT = "_corrupt_record"
EMPTY = "_no_value"
_MESSAGE = T.StructType(
    [T.StructField(field, PING[column].dataType) for field, column in PING_JSON.items()]
    + [T.StructField(CORRUPT, T.StringType())]
)


# ---- encode -----------------------------------------------------------------------


def encode_kv(pings: DataFrame) -> DataFrame:
    """Pings to keyed JSON messages; pings without a key are dropped."""
    return producible(pings).select(
        F.col("user_id").alias("key"), F.to_json(document()).alias("value"), "seq", "ingest_ms"
    )


def map_columns(pings: DataFrame, null_text: bool = False) -> DataFrame:
    """Pings as the text fields of a string-map record."""

    def text(name: str):
        return text_or_null_word(F.col(name), null_text)

    return pings.select(
        "seq", "ingest_ms",
        F.col("user_id").alias("trj_id"),
        F.col("service_type").alias("driving_mode"),
        text("ts_ms").alias("pingtimestamp"),
        text("latitude").alias("rawlat"),
        text("longitude").alias("rawlng"),
        text("speed").alias("speed"),
        text("heading").alias("bearing"),
        text("accuracy").alias("accuracy"),
        lng_lat_text(F.col("longitude"), F.col("latitude")).alias("location"),
        hex_cell(F.col("latitude"), F.col("longitude")).alias("cell"),
    )


def encode_map(records: DataFrame) -> DataFrame:
    """String-map records to keyed JSON messages; absent fields are left out."""
    entries = [c for name, field in MAP_FIELDS.items() for c in (F.lit(field), F.col(name))]
    present = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return records.select(
        F.col("trj_id").alias("key"), F.to_json(present).alias("value"), "seq", "ingest_ms"
    )


# ---- decode -----------------------------------------------------------------------


def decode_pings(messages: DataFrame, arrival_as_timestamp: bool = False) -> DataFrame:
    """Typed pings; ``_corrupt_record`` holds the text of a message that is no ping, and
    ``_no_value`` marks a message without one.

    A ping without a time stamp keeps none, or takes its arrival time on request.
    """
    value = F.from_json("value", _MESSAGE,
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    fields = [F.col(f"_p.{field}").alias(column) for field, column in PING_JSON.items()]
    pings = messages.withColumn("_p", value).select(
        "seq", *fields, "ingest_ms", f"_p.{CORRUPT}", F.col("value").isNull().alias(EMPTY)
    )
    if arrival_as_timestamp:
        pings = pings.withColumn("ts_ms", F.coalesce("ts_ms", "ingest_ms"))
    return pings


def split_poison(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable pings, and the messages to put aside: malformed ones and ones without a value."""
    bad = F.col(CORRUPT).isNotNull() | F.col(EMPTY)
    return decoded.where(~bad).drop(CORRUPT, EMPTY), decoded.where(bad).select(
        "seq", F.col(CORRUPT).alias("value"), "ingest_ms"
    )


def marked_poison(decoded: DataFrame) -> DataFrame:
    """Pings that can be applied, and the messages that are none, in one table: ``poison`` tells
    them apart, ``value`` holds the text of a poison message. Other pings are dropped."""
    bad = F.col(CORRUPT).isNotNull() | F.col(EMPTY)
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    return decoded.withColumn("poison", bad).where(F.col("poison") | usable).withColumn(
        "value", F.col(CORRUPT)).drop(CORRUPT, EMPTY)


def decode_map(messages: DataFrame) -> DataFrame:
    """String-map messages back to one text column per field."""
    fields = F.from_json("value", "map<string,string>")
    return messages.withColumn("_m", fields).select(
        "seq", "ingest_ms", *[F.col("_m").getItem(f).alias(n) for n, f in MAP_FIELDS.items()]
    )


def decode_numeric(records: DataFrame) -> DataFrame:
    """Text fields to numbers, each on its own; ``parse_errors`` names those that failed."""
    as_number = {
        "pingtimestamp": F.col("pingtimestamp").try_cast("long"),
        "speed": F.col("speed").try_cast("double"),
        "bearing": F.col("bearing").try_cast("double").try_cast("int"),
        "accuracy": F.col("accuracy").try_cast("double"),
    }
    errors = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull() & number.isNull(), F.lit(name))
        for name, number in as_number.items()
    ]))
    return records.withColumns({**as_number, "parse_errors": errors})


# ---- storage ----------------------------------------------------------------------


def write_topic(messages: DataFrame, path: str) -> None:
    """Append keyed messages to a folder of Parquet files, the file form of a topic."""
    messages.write.mode("append").parquet(path)


def start_topic(messages: DataFrame, path: str, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Send a stream of keyed messages to a topic folder.

    The sink keeps a log of the batches it has taken, and takes none twice: a batch that is
    repeated after a failure adds no message. Readers, streams too, see only what is in the log.
    The messages of a key are in one file per batch; ``seq`` tells their order.
    """
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    by_key = messages.select(*TOPIC.fieldNames()).repartition("key")
    return (
        by_key.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All messages of a topic folder."""
    return spark.read.schema(TOPIC).parquet(path)


def write_topic_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    (
        messages.select("key", "value").write.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    )


def message_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Streaming messages ``key, value, seq, ingest_ms`` from the earliest on.

    Files need ``path`` and accept ``maxFilesPerTrigger``. For ``kafka``, offsets give the
    order within a partition, hence within a key.
    """
    if source not in FORMATS:
        raise ValueError(f"source must be one of {FORMATS}, not {source!r}")
    reader = spark.readStream.format(source)
    if source != "kafka":
        return reader.schema(TOPIC).options(**options).load()
    return reader.options(**{"startingOffsets": "earliest", **options}).load().select(
        F.col("key").cast("string"), F.col("value").cast("string"),
        F.col("offset").alias("seq"), F.unix_millis("timestamp").alias("ingest_ms"),
    )


def ping_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Typed streaming pings, poison messages marked in ``_corrupt_record``."""
    return decode_pings(message_stream(spark, source, **options))
