"""The folder for intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    if base := spark.conf.get("spark.checkpoint.dir", ""):
        return base
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written there. Call it when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
