"""Cutting lineage through the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a folder of this machine in local mode, as in tests; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="veridex-"))
    return _OWN[0]


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that nobody else uses; what is written there goes when the driver ends."""
    path = f"{folder(spark)}/veridex-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, so that what follows reads files and not the lineage."""
    path = new_path(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
