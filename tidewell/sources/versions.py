"""Tables in versions: data are staged first, and one small file makes them current, with the watermark they reach.

A table is a folder with ``parts`` (folders of Parquet files) and ``commits`` (numbered JSON files). A commit names the parts of a
version and its watermark. It is written beside its place and renamed into it, which fails if another has taken it: so
a version appears whole or not at all, and data and watermark move together. A job that is killed before the rename leaves the old
version and watermark; the parts it staged are of no version, and :func:`vacuum` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.lineage import removed


class Conflict(RuntimeError):
    """Another commit came first; its version is in force."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[str, ...] = ()
    watermark: Any = None


def _context(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jvm.org.apache.hadoop.fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def _named(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def current(spark: SparkSession, path: str) -> Version:
    """The version in force; number 0 without parts where nothing was committed."""
    numbers = [int(n[:-5]) for n in _named(spark, f"{path}/commits") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return Version(0)
    body = json.loads(spark.read.text(f"{path}/commits/{max(numbers):010d}.json", wholetext=True).first()[0])
    return Version(max(numbers), tuple(body["parts"]), body["watermark"])


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the version in force; None where there is none yet."""
    parts = current(spark, path).parts
    return spark.read.parquet(*[f"{path}/parts/{p}" for p in parts]) if parts else None


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    paths = spark._jvm.org.apache.hadoop.fs
    place, beside = (paths.Path(f"{path}/commits/{name}") for name in (f"{version.number:010d}.json", f".{uuid.uuid4().hex}"))
    fs = beside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps({"parts": version.parts, "watermark": version.watermark}).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        _context(spark, path).rename(beside, place, none)
    except Exception as e:
        fs.delete(beside, False)
        raise Conflict(f"version {version.number} of {path} exists") from e


def _staged(df: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/parts/{name}")
    return name


def replace(df: DataFrame, path: str, watermark: Any = None, base: Version | None = None) -> Version:
    """Truncate and reload: the rows of ``df`` become the table, in one step. ``base``: the version that ``df`` was made from, where it was."""
    base = base or current(df.sparkSession, path)
    new = Version(base.number + 1, (_staged(df, path),), watermark)
    _commit(df.sparkSession, path, new)
    return new


def append(df: DataFrame, path: str, watermark: Any, base: Version | None = None) -> Version:
    """Add rows and move the watermark, in one step; an empty ``df`` moves the watermark alone."""
    base = base or current(df.sparkSession, path)
    part = () if df.isEmpty() else (_staged(df, path),)
    new = Version(base.number + 1, (*base.parts, *part), watermark)
    _commit(df.sparkSession, path, new)
    return new


def copy_table(source: DataFrame, path: str, key: str, batch: int = 500) -> int:
    """Copy a table by its key in batches, each committed with the key it reaches; goes on behind the last one. Returns rows copied.

    The key is not null and rises with every row; rows below what is copied already are not looked at again.
    """
    spark, copied = source.sparkSession, 0
    while True:
        base = current(spark, path)
        left = source if base.watermark is None else source.filter(F.col(key) > F.lit(base.watermark))
        # the batch's last key first, so that a repeated attempt takes the same rows
        last = left.select(key).orderBy(key).limit(batch).agg(F.max(key)).first()[0]
        if last is None:
            return copied
        rows = left.filter(F.col(key) <= F.lit(last))
        append(rows, path, last, base)
        copied += rows.count()


def harvest(items: DataFrame, path: str, time: str, until: Any, work: Callable[[DataFrame], DataFrame]) -> Version:
    """Run ``work`` over rows in (watermark, until], append its result and move the watermark to ``until``, also where it is empty.

    If ``work`` fails, or the job is killed, neither moves. Times are compared as ISO strings are given: as timestamps.
    """
    base = current(items.sparkSession, path)
    new = items.filter(F.col(time) <= F.lit(until).cast("timestamp"))
    if base.watermark is not None:
        new = new.filter(F.col(time) > F.lit(base.watermark).cast("timestamp"))
    return append(work(new), path, until, base)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete parts that the version in force does not name; no writer may be at work. Returns their names."""
    kept = set(current(spark, path).parts)
    gone = [p for p in _named(spark, f"{path}/parts") if p not in kept]
    for p in gone:
        removed(spark, f"{path}/parts/{p}")
    return sorted(gone)
