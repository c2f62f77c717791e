"""Staging frames that are used more than once, the order of notifications in files, files by name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


class Staging:
    """Frames that are used more than once, below one folder of the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"

    def __call__(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back: computed once, lineage cut."""
        path = f"{self.folder}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Staging]:
    """Staged frames for one piece of work; they go when it is done, or has failed."""
    stage = Staging(spark)
    try:
        yield stage
    finally:
        drop_folder(spark, stage.folder)


def by_day_and_account(notifications: DataFrame) -> DataFrame:
    """Dealt by day, sorted by account within files.

    A day is one file until Spark splits one that is too large for a task; the sort lets a
    reader of one account skip most row groups.
    """
    return notifications.hint("rebalance", "created_date").sortWithinPartitions(
        "created_date", "account", "block_num", "op_id", "hook_ord"
    )


def located(spark: SparkSession, path: str):
    """A path and the file system it lies in, whichever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = located(spark, path)
    return system.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a name of its own, such as a rule file."""
    system, place = located(spark, path)
    out = system.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def folders(spark: SparkSession, pattern: str, before: float | None = None) -> list[str]:
    """Paths that a glob pattern finds; with ``before``, those not changed since (milliseconds)."""
    system, place = located(spark, pattern)
    return [
        status.getPath().toString() for status in system.globStatus(place) or ()
        if before is None or status.getModificationTime() < before
    ]


def drop_folder(spark: SparkSession, path: str) -> None:
    system, place = located(spark, path)
    system.delete(place, True)
