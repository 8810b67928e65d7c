"""A position table in versions, written by several jobs and read as of any version.

A commit writes reduced rows (:func:`fleetlens.operators.state.reduce_pings`) to a folder of its
own, and then lists the folder under the next free version number. A number is taken by renaming a
file to its name, which the store grants to one writer; whoever loses takes the next one. Readers go
by the list alone, so they never see a commit that is half written, nor one that failed. Rows of
several commits are merged by arrival order, so it does not matter which writer came first.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.state import merge_reduced, reduce_pings

# ``upto``: a base holds all commits up to that version; others have none.
ENTRY = "version long, folder string, writer string, batch long, upto long"
PARTS = ("user_id string, lat double, lng double, speed double, accuracy double, service_type string, "
         "ts_ms long, updated_ms long, seq long, first_seq long")


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _take(spark: SparkSession, path: str, entry: dict) -> bool:
    """List ``entry`` under its version, unless another writer has that number."""
    hadoop, draft = spark._jvm.org.apache.hadoop.fs, _path(spark, path, f"draft-{uuid.uuid4().hex}")
    out = _store(spark, path).create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        _store(spark, path).mkdirs(_path(spark, path, "log"))
        context.rename(context.makeQualified(draft), context.makeQualified(_path(spark, path, "log", f"{entry['version']:012d}")), no_overwrite)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        context.delete(draft, False)
        return False


def log(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a table, one row per version; none if there is no table yet."""
    try:
        return spark.read.schema(ENTRY).json(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def latest(spark: SparkSession, path: str) -> int:
    """The newest version, -1 if there is none."""
    newest = log(spark, path).agg(F.max("version")).head()[0]
    return -1 if newest is None else newest


def commit(parts: DataFrame, path: str, writer: str | None = None, batch: int | None = None,
           upto: int | None = None) -> int:
    """Add reduced rows as a new version and return its number. A batch that its writer has
    committed before adds nothing."""
    spark = parts.sparkSession
    if writer is not None and batch is not None:
        done = log(spark, path).where((F.col("writer") == writer) & (F.col("batch") == batch)).agg(F.max("version")).head()[0]
        if done is not None:
            return done
    folder = f"data-{uuid.uuid4().hex}"
    parts.write.parquet(f"{path}/{folder}")
    version = latest(spark, path) + 1
    while not _take(spark, path, {"version": version, "folder": folder, "writer": writer, "batch": batch, "upto": upto}):
        version += 1
    return version


def start_commits(pings: DataFrame, path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """A stream of pings as commits, one per micro-batch, each exactly once. ``writer`` names the
    job; it must be its own and stay the same after a restart."""
    return (
        pings.writeStream.foreachBatch(lambda rows, n: commit(reduce_pings(rows), path, writer, n) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _base(spark: SparkSession, path: str, version: int) -> tuple[int, int]:
    """(version, last commit in it) of the newest base that a reader of ``version`` may use."""
    row = (
        log(spark, path).where(F.col("upto").isNotNull() & (F.col("version") <= version))
        .orderBy(F.desc("upto"), F.desc("version")).select("version", "upto").head()
    )
    return (row["version"], row["upto"]) if row else (-1, -1)


def positions_as_of(spark: SparkSession, path: str, version: int | None = None,
                    order_by: str = "seq") -> DataFrame:
    """The position table after the commits up to ``version``, by default all. Versions that were
    removed are an error."""
    version = latest(spark, path) if version is None else version
    base, upto = _base(spark, path, version)
    wanted = (F.col("version") == base) | (F.col("upto").isNull() & (F.col("version") > upto) & (F.col("version") <= version))
    # one row per commit since the base
    found = log(spark, path).where(wanted).select("version", "folder").collect()
    commits = {r["version"] for r in log(spark, path).where("upto is null").select("version").collect()}
    if base < 0 and version >= 0 and 0 not in commits:
        raise ValueError(f"version {version} was removed")
    if not found:
        return merge_reduced(spark.createDataFrame([], PARTS), order_by)
    return merge_reduced(spark.read.schema(PARTS).parquet(*[f"{path}/{r['folder']}" for r in found]), order_by)


def fold(spark: SparkSession, path: str, order_by: str = "seq") -> int:
    """Merge all commits so far into a base, itself a version; later readers start from it."""
    upto = latest(spark, path)
    return commit(positions_as_of(spark, path, upto, order_by), path, upto=upto)


def remove_before(spark: SparkSession, path: str, version: int) -> None:
    """Remove what only readers of versions before ``version`` need: everything up to the newest
    base that a reader of ``version`` may use. Readers of older versions fail from then on."""
    base, upto = _base(spark, path, version)
    old = log(spark, path).where((F.col("version") <= upto) & (F.col("version") != base)).select("version", "folder").collect()
    store = _store(spark, path)
    for row in old:         # off the list first: a reader sees all of a commit or none of it
        store.delete(_path(spark, path, "log", f"{row['version']:012d}"), False)
        store.delete(_path(spark, path, row["folder"]), True)
