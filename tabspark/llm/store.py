"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows of one key (8 bytes each, 16 MB in all) is broadcast; a larger one is shuffled.
BROADCAST_KEYS = 1_000_000

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of its own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tabspark-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder name that nothing uses yet; the folder goes when the driver ends."""
    path = f"{shared_dir(spark)}/tabspark-{tag}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut in the lineage that lost executors don't undo."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes materialized tables that no plan to come reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            delete(df.sparkSession, files[0].rpartition("/")[0])


def by_keys(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a materialized one-column table, broadcast only if its counted rows are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, how)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone; the folder is then the cluster's to clean
            return
