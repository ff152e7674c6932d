"""Cutting a plan's lineage in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder of checkpoints where ``spark.checkpoint.dir`` is unset and driver and executors are one process.
LOCAL_FOLDER = "/tmp/checkpoints/tidewell"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Unset on one machine (``local`` masters, as in tests) it is LOCAL_FOLDER; unset on a
    cluster it is an error, as executors of their own could not read what the others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    return LOCAL_FOLDER


def removed(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Files of :func:`cut` within go to a folder of their own, which is deleted at the end.

    What is to be kept has to be written before that: plans over cut files do not work afterwards.
    """
    at = f"{shared_folder(spark)}/scratch/{uuid.uuid4().hex}"
    outer = _scratch.set(at)
    try:
        yield
    finally:
        _scratch.reset(outer)
        removed(spark, at)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under :func:`shared_folder` and go on from the files.

    A checkpoint would cut the plan as well, but hands its estimates of size and its constraints on. Those of a
    join are products of its sides', so that over the rounds of a loop they grow to numbers of millions of
    digits, and planning stands still. Files have their true size, and later scans read only the columns they need.
    """
    spark = df.sparkSession
    at = f"{_scratch.get() or shared_folder(spark) + '/cut'}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
