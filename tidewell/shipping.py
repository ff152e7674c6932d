"""Python functions over Arrow batches, with the package's sources sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows that a Python function gets at once. Spark bounds the bytes of a batch (64 MB by default); this
#: bounds what a function makes of it.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    root = Path(__file__).resolve().parent
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
