"""Tables that a run writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that `settled` wrote and nothing has deleted yet.
_WRITTEN: list[str] = []


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder: in spark.checkpoint.dir; where that is unset and the session is within one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"gneiss-{kind}-")


def tidy(spark: SparkSession) -> None:
    """Delete what `settled` wrote so far."""
    while _WRITTEN:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session is gone: nothing is left to tidy with
            return


def settled(df: DataFrame, kind: str) -> DataFrame:
    """df, written and read again: a cut that Spark made by a sample stays as it is, whatever executor is lost."""
    path = folder(df.sparkSession, kind)
    df.write.mode("overwrite").parquet(path)
    if not _WRITTEN:
        atexit.register(tidy, df.sparkSession)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
