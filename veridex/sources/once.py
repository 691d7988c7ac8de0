"""Results that are written once: an exclusive claim, a whole folder moved into place, and a record of what was written."""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class AlreadyClaimedError(ValueError):
    """Another writer has the claim, or has written already."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, record: dict) -> None:
    """Creates a file that must not be there yet.  Of any number of writers one succeeds, the others get an error.

    A path of this machine is created by its operating system, which is exclusive where Spark's local store isn't; any
    other by its store, which has to create exclusively, as a distributed file system does.
    """
    text = json.dumps(record, sort_keys=True) + "\n"
    place, store = _place(spark, path)
    if store.getUri().getScheme() == "file":
        bare = place.toUri().getPath()
        os.makedirs(os.path.dirname(bare), exist_ok=True)
        try:
            handle = os.open(bare, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError as error:
            raise AlreadyClaimedError(path) from error
        with os.fdopen(handle, "w") as file:
            file.write(text)
        return
    try:
        stream = store.create(place, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise AlreadyClaimedError(path) from error
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def _replace(spark: SparkSession, path: str, record: dict) -> None:
    place, store = _place(spark, path)
    stream = store.create(place, True)
    stream.write(bytearray((json.dumps(record, sort_keys=True) + "\n").encode()))
    stream.close()


def read_claim(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.lock", wholetext=True).first()["value"])


def write_once(frame: DataFrame, path: str, **record: str) -> None:
    """Writes a frame as Parquet to a folder that nobody has written or is writing; else AlreadyClaimedError.

    The claim is <path>.lock: status started, then complete with the number of rows.  The folder appears whole, by one
    rename.  A write that fails leaves neither folder nor claim.
    """
    spark = frame.sparkSession
    lock, staging = f"{path}.lock", f"{path}.staging-{uuid.uuid4().hex}"
    claim(spark, lock, {"status": "started", **record})
    try:
        target, store = _place(spark, path)
        if store.exists(target):
            raise AlreadyClaimedError(path)
        frame.write.parquet(staging)
        rows = spark.read.schema(frame.schema).parquet(staging).count()
        if not store.rename(_place(spark, staging)[0], target):
            raise OSError(f"couldn't move the result to {path}")
    except BaseException:
        for left in (staging, lock):
            with contextlib.suppress(Exception):  # what went wrong first is what counts
                place, store = _place(spark, left)
                store.delete(place, True)
        raise
    _replace(spark, lock, {"status": "complete", "rows": rows, **record})
