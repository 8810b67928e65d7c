"""Session settings, the shared folder, and size checks on plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the jobs are planned for. Partition counts are left to the
# cluster: AQE coalesces small shuffle partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method of more bytes: a stage that needs one runs faster as single
    # operators, whose methods are short, than interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows with the edges of a polygon as columns are wider than the default of 100.
    "spark.sql.codegen.maxFields": "250",
}

# Largest table, with all copies counted, that is broadcast: rows that were counted, and
# Catalyst's estimate, which alone proves nothing (it does not see rows made by an explode).
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# Inputs below this per core are spread over all cores before an explode.
SPREAD_BYTES = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's shared checkpoint folder.

    Streaming checkpoints and intermediate tables must outlive an executor, so a
    cluster has to name the folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors share one disk, may do without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # local[...] only: in local-cluster[...] executors are processes of their own
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="fleetlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once however often it
    is used, its size is known, and a lost executor costs only its own tasks."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; huge where there is none."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return 1 << 62


def may_broadcast(df: DataFrame, copies: int = 1, counted: int | None = None) -> bool:
    """True if ``df`` is small enough to broadcast after an explode into ``copies`` rows.

    The estimate only saves the count where the answer is no; the rows are counted, up to
    one more than may be, unless a bound on them is known as ``counted``.
    """
    most = BROADCAST_ROWS // copies
    if planned_bytes(df) * copies > BROADCAST_BYTES:
        return False
    return (df.limit(most + 1).count() if counted is None else counted) <= most


def measured_small(df: DataFrame, copies: int = 1) -> bool:
    """As :func:`may_broadcast` where Catalyst's estimate alone says no: it takes a grouped table to be as
    large as what it was grouped from. Rows and lengths of texts are measured; other columns have 8 bytes."""
    kinds = [f.dataType.typeName() for f in df.schema]
    if planned_bytes(df) * copies <= BROADCAST_BYTES or {"array", "map", "struct", "binary", "variant"} & {*kinds}:
        return False
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in zip(df.columns, kinds) if kind == "string"]
    width = sum(texts, F.lit(8 * (len(kinds) + 1))).cast("long")
    rows, size = df.agg(F.count("*"), F.sum(width)).head()
    return rows * copies <= BROADCAST_ROWS and (size or 0) * copies <= BROADCAST_BYTES


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small input over all cores, by ``key``. A large one has splits enough and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if planned_bytes(df) < SPREAD_BYTES * cores else df


def seam(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a seam between what is below and what is above: a function on a list has no place
    in a generated stage, so two methods are made of one that the JVM would not compile. It costs a
    copy of every row."""
    return df.withColumn(column, F.get(F.transform(F.array(column), lambda x: x), 0))
