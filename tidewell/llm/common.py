"""Shared pieces: word rule, table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.lineage import cut

__all__ = ["GAP", "WORD", "cut", "join_grouped", "lookup", "map_arrow", "ship", "small", "table", "unit_interval", "words"]

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows that a Python function gets at once. Spark bounds the bytes of a batch (64 MB by default); this
#: bounds what a function makes of it.
BATCH_ROWS = 512
#: Keys with more rows than this and more than a thousandth of all rows are joined by broadcast.
HOT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def small(df: DataFrame, rows: int = 100_000, size: int = 16_000_000) -> DataFrame:
    """``df``, which is cut already, to be broadcast if it has at most ``rows`` rows and, as text, ``size`` characters; else as it is."""
    if df.count() > rows:
        return df
    held = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if held <= size else df


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "tidewell_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tidewell_shipped = True


def map_arrow(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` with parts of batches of at most ``rows`` rows."""
    ship(df.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow(lambda batches: function(parts(batches)), schema)


def join_grouped(rows: DataFrame, per_key: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row a key and its number of rows in ``held``.

    No task gets all rows of a hot key: one that holds more than a thousandth of the ``total`` rows
    (so at most a thousand keys of any table, which are broadcast) is salted into parts of that size, and its
    row of ``per_key`` is repeated for each. ``rows`` is read once, ``per_key`` twice.
    """
    limit = max(HOT_ROWS, total // 1000)
    if total <= limit:
        return rows.join(per_key, key)
    parts = F.ceil(F.col(held) / limit)
    hot = F.broadcast(per_key.filter(F.col(held) > limit).select(key, parts.alias("__tw_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__tw_parts")), F.lit(0)).cast("int")
    salted = rows.join(hot, key, "left").withColumn("__tw_salt", salt).drop("__tw_parts")
    last = F.when(F.col(held) > limit, parts - 1).otherwise(0).cast("int")
    return salted.join(per_key.withColumn("__tw_salt", F.explode(F.sequence(F.lit(0), last))), [key, "__tw_salt"]).drop("__tw_salt")


def lookup(rows: DataFrame, per_key: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """``rows`` with the ``wanted`` columns of ``per_key``, which is cut and has a row a key; null where it has none.

    Keys that hold more than a thousandth of the rows, a thousand at most, are looked up by broadcast, the
    others by a join of their own; rows without a key go to neither. So no task gets all rows of one.
    """
    side = small(per_key)
    if side is not per_key:
        return rows.join(side, key, "left").select(*rows.columns, *wanted)
    held = cut(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__tw_n")))
    limit = max(HOT_ROWS, (held.agg(F.sum("__tw_n")).first()[0] or 0) // 1000)
    hot = cut(held.filter(F.col("__tw_n") > limit).select(key))
    hot_rows = hot.join(per_key, key, "left").select(key, *wanted)
    found = rows.join(F.broadcast(hot_rows), key).select(*rows.columns, *wanted)
    cold = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(per_key, key, "left").select(*rows.columns, *wanted)
    types = {f.name: f.dataType for f in per_key.schema}
    none = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in wanted])
    return found.unionByName(cold).unionByName(none)


def unit_interval(*columns: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the given values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)
