"""Tables that outlive a query: in the folder that driver and executors share, deleted when the driver ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The session's own folder in spark.checkpoint.dir, or where a session names none, in its warehouse; driver and executors share both."""
    path = getattr(spark, "_conceptlake_shared", None)
    if path is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        path = spark._conceptlake_shared = f"{base.rstrip('/')}/conceptlake-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone
        pass


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_path(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read again, so that its size is known to the planner."""
    path = f"{shared_path(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
