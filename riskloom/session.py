"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the intermediate tables that ``materialize`` has made in this process.
_MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on: event times are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path of the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder unless the cluster already did."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: it is computed once, however
    often it is used, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.append(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(stored: DataFrame) -> None:
    """Delete an intermediate table once nothing reads it any more; other frames are left alone."""
    path = getattr(stored, "_stored_at", None)
    if path in _MADE:
        _MADE.remove(path)
        _delete(stored.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now.

    Spark deletes them once the driver has collected the plans that made them; after a step has been
    written to a table its plans are no longer needed, so collect them before the next step starts.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean_up(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process has made and not discarded; returns their number.

    For the end of a job: results that still read them are gone then, unless they have been written elsewhere.
    """
    count = len(_MADE)
    while _MADE:
        _delete(spark, _MADE.pop())
    return count
