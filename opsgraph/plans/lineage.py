"""Cutting lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session (tests) may go without one that is set; there a temporary one stands in."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df, written to the shared folder and read back.

    A written table survives lost executors, and its size is known to the joins that read it. It goes
    with the session, or before by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    read = spark.read.schema(df.schema).parquet(path)
    read._cut_at = path
    return read


def forget(df: DataFrame) -> None:
    """Deletes what cut() wrote; for tables that nothing reads any more."""
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
