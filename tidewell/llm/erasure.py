"""Cascading erasure: tables laid out in ordered files, victims found through their links, files rewritten.

Rows of every table are ranked by a total order, and a file holds a run of ranks. Victims cascade from masters to
clients, from these to clicks and sales, from sales to their lines. A victim is known by its rank alone: ranks
collapse into intervals (gaps and islands), an interval is split at file boundaries by integer division of its ends,
and a file with intervals is rewritten from Arrow slices of the rows between them. Files without one are not touched.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import dirname

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.lineage import removed, scratch, shared_folder
from tidewell.llm.common import cut, lookup, map_arrow

#: A table of n rows has files of 1 + n div FILES rows.
FILES = 150
#: Masters whose crc32 is divisible by this are victims.
MODULUS = 100
#: Ranks whose islands are found together: no window holds more rows.
BLOCK = 50_000
#: Rows read at once, and rows of a row group of a rewritten file.
READ_ROWS, GROUP_ROWS = 65_536, 262_144


@dataclass(frozen=True)
class Layout:
    """A table's written files: ``at`` the folder, ``ranked`` its rows' ranks with ``victim``, ``n`` rows, ``per_file`` rows a file."""

    name: str
    at: str
    ranked: DataFrame
    n: int
    per_file: int
    columns: list[str]
    cents_of: str | None


def checksum(client_id: Column) -> Column:
    """crc32 of the decimal client_id; null: of the empty string."""
    return F.crc32(F.coalesce(client_id.cast("string"), F.lit("")).cast("binary"))


def victim_master(clients: DataFrame, clicks: DataFrame) -> int | None:
    """The master whose clients together have most clicks rows, the smallest of equals; None without masters."""
    per_client = cut(clicks.filter("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n")))
    owned = clients.filter("master_id is not null").select("master_id", "client_id").distinct()
    top = owned.join(per_client, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    first = top.orderBy(F.desc("n"), "master_id").first()
    return first["master_id"] if first else None


def keyed(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, modulus: int = MODULUS) -> dict[str, DataFrame]:
    """Each table with ``__tw_crc``, the first sort key, and ``__tw_victim``.

    A sale with several rows has the smallest client_id of them as the key of its lines, and is a victim
    if one of its rows is.
    """
    top = victim_master(clients, clicks)
    own = F.crc32(F.col("master_id").cast("string").cast("binary")) % modulus == 0
    hit = F.coalesce(own | (F.col("master_id") == F.lit(top)), F.lit(False))
    people = clients.withColumns({"__tw_crc": checksum(F.col("client_id")), "__tw_victim": hit})
    erased = cut(people.filter("__tw_victim and client_id is not null").select("client_id").distinct().withColumn("__tw_hit", F.lit(True)))

    def by_client(df: DataFrame) -> DataFrame:
        found = lookup(df, erased, "client_id", ["__tw_hit"])
        return found.withColumns({"__tw_crc": checksum(F.col("client_id")), "__tw_victim": F.coalesce("__tw_hit", F.lit(False))}).drop("__tw_hit")

    bought = by_client(sales)
    per_sale = bought.filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("__tw_client"), F.max("__tw_victim").alias("__tw_hit"))
    lines = lookup(sale_lines, cut(per_sale), "sale_id", ["__tw_client", "__tw_hit"])
    lines = lines.withColumns({"__tw_crc": checksum(F.col("__tw_client")), "__tw_victim": F.coalesce("__tw_hit", F.lit(False))}).drop("__tw_client", "__tw_hit")
    return {"clients": people, "clicks": by_client(clicks), "sales": bought, "sale_lines": lines}


def lay_out(df: DataFrame, name: str, at: str, cents_of: str | None, files: int = FILES) -> Layout:
    """Write a keyed table in its order as Parquet files ``<at>/<name>/part-K...`` of equal numbers of rows, K from 0.

    Rows are sorted by ranges, so no task gets all rows of a hot key; a row's rank is its place in
    its range and the number of rows of the ranges before, of which there are as many as partitions. Rows
    that are equal in all columns are interchangeable.
    """
    columns = [c for c in df.columns if not c.startswith("__tw_")]
    order = [F.col(c).asc_nulls_first() for c in ("__tw_crc", *columns)]
    place = F.monotonically_increasing_id()
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = cut(runs.withColumns({"__tw_run": F.shiftright(place, 33), "__tw_idx": place.bitwiseAND(F.lit((1 << 33) - 1))}).drop("__tw_crc"))
    per_run = runs.groupBy("__tw_run").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.orderBy("__tw_run")) - F.col("held")
    per_run = cut(per_run.withColumns({"__tw_before": before}))  # a row a partition
    n = per_run.agg(F.sum("held")).first()[0] or 0
    per_file = 1 + n // files
    rank = F.col("__tw_before") + F.col("__tw_idx")
    ranked = runs.join(F.broadcast(per_run.drop("held")), "__tw_run").withColumn("__tw_rank", rank).withColumn("__tw_file", F.expr(f"int(__tw_rank div {per_file})"))
    target = f"{at}/{name}"
    if n:
        dealt = ranked.repartitionById(-(-n // per_file), F.col("__tw_file")).sortWithinPartitions("__tw_rank")
        own = F.when(F.col("__tw_file") == F.spark_partition_id(), F.lit(True)).otherwise(F.raise_error(F.lit("a task got the rows of another file")).cast("boolean"))
        dealt.filter(own).select(*columns).write.option("maxRecordsPerFile", 0).parquet(target)
    return Layout(name, target, ranked.select("__tw_rank", "__tw_victim"), n, per_file, columns, cents_of)


def intervals(ranks: DataFrame, per_file: int, block: int = BLOCK) -> DataFrame:
    """``file_no``, ``spans``: victims' ``__tw_rank`` s as sorted intervals (first, last), counted from the file's first row.

    Islands are found within blocks of ranks, split at file boundaries, and joined where one goes on in the next block.
    """
    island = F.col("__tw_rank") - F.row_number().over(Window.partitionBy("block").orderBy("__tw_rank"))
    found = ranks.select("__tw_rank", F.expr(f"__tw_rank div {block}").alias("block")).withColumn("island", island)
    found = found.groupBy("block", "island").agg(F.min("__tw_rank").alias("lo"), F.max("__tw_rank").alias("hi"))
    split = found.withColumn("file_no", F.explode(F.sequence(F.expr(f"lo div {per_file}"), F.expr(f"hi div {per_file}"))))
    first = F.col("file_no") * per_file
    clipped = split.select("file_no", F.struct((F.greatest("lo", first) - first).alias("lo"), (F.least("hi", first + per_file - 1) - first).alias("hi")).alias("span"))
    # of a file's spans in order, those that carry on the one before are joined with it
    spans = clipped.groupBy("file_no").agg(F.sort_array(F.collect_list("span")).alias("all"))
    starts = F.filter("all", lambda x, i: F.coalesce(F.get(F.col("all"), i - 1)["hi"] + 1 != x["lo"], F.lit(True)))
    ends = F.filter("all", lambda x, i: F.coalesce(F.get(F.col("all"), i + 1)["lo"] != x["hi"] + 1, F.lit(True)))
    return spans.select("file_no", F.zip_with(starts, ends, lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi"))).alias("spans"))


def surviving(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, end) of the rows of a file of ``n`` that no span holds; spans are in order and apart."""
    out, at = [], 0
    for lo, hi in spans:
        if lo > at:
            out.append((at, lo))
        at = hi + 1
    return [*out, (at, n)] if at < n else out


def slices(batches: Iterator[pa.RecordBatch], kept: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The parts of the batches that ``kept`` holds, as slices of their buffers."""
    at, k = 0, 0
    for batch in batches:
        end = at + batch.num_rows
        while k < len(kept) and kept[k][0] < end:
            lo, hi = max(kept[k][0], at), min(kept[k][1], end)
            if lo < hi:
                yield batch.slice(lo - at, hi - lo)
            if kept[k][1] > end:
                break
            k += 1
        at = end


class Digest:
    """Rows, cents and the digest of the first column of a file, added up batch by batch."""

    def __init__(self) -> None:
        self.rows, self.cents, self._sha = 0, 0, hashlib.sha256()

    def add(self, ids: pa.Array, amounts: pa.Array | None) -> None:
        text = ",".join(pc.fill_null(pc.cast(ids, pa.string()), "").to_pylist())
        self._sha.update((f",{text}" if self.rows else text).encode())
        self.rows += len(ids)
        if amounts is not None:
            x = np.floor(100 * amounts.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) + 0.5)
            self.cents += sum(map(int, x[np.isfinite(x)].tolist()))

    @property
    def ids(self) -> str:
        return self._sha.hexdigest()


def _write(batches: Iterator[pa.RecordBatch], schema: pa.Schema, fs, path: str, digest: Digest, first: str, cents_of: str | None) -> None:
    """Write slices as row groups of about GROUP_ROWS rows: tables of slices, whose buffers are not copied before encoding."""

    def flush(writer: pq.ParquetWriter, held: list[pa.RecordBatch]) -> None:
        if held:
            writer.write_table(pa.Table.from_batches(held, schema), row_group_size=GROUP_ROWS)

    with fs.open_output_stream(path) as out, pq.ParquetWriter(out, schema, compression="snappy") as writer:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            digest.add(batch.column(first), batch.column(cents_of) if cents_of else None)
            held.append(batch)
            if sum(b.num_rows for b in held) >= GROUP_ROWS:
                flush(writer, held)
                held = []
        flush(writer, held)


def _rewrite(batches: Iterator[pa.RecordBatch], work: str) -> Iterator[pa.RecordBatch]:
    """One row per file: its digests, and for a file with spans the path of its new version under ``work``.

    A new version has a name of its own, so attempts of a task don't meet; those of lost attempts go with the folder.
    """
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(row["path"])
            digest, new = Digest(), None
            with fs.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                n, first, money = file.metadata.num_rows, row["columns"][0], row["cents_of"]
                kept = surviving(n, [(s["lo"], s["hi"]) for s in row["spans"] or []])
                if not row["spans"]:
                    for part in file.iter_batches(READ_ROWS, columns=[first, *([money] if money else [])]):
                        digest.add(part.column(first), part.column(money) if money else None)
                elif kept:
                    new = f"{work}/{row['table_name']}-{row['file_no']}-{uuid.uuid4().hex}.parquet"
                    folder, target = pa.fs.FileSystem.from_uri(new)
                    folder.create_dir(dirname(target), recursive=True)
                    _write(slices(file.iter_batches(READ_ROWS), kept), file.schema_arrow, folder, target, digest, first, money)
            out.append({"table_name": row["table_name"], "file_no": row["file_no"], "path": row["path"], "new": new, "n_rows": digest.rows, "n_erased": n - digest.rows, "cents": digest.cents, "ids_sha256": digest.ids})
        yield pa.RecordBatch.from_pylist(out, schema=_DONE)


def written_files(spark: SparkSession, layout: Layout) -> list[tuple[int, str]]:
    """(file_no, path) of a layout's files, FILES at most: the number of the task that wrote a file is in its name."""
    if not layout.n:
        return []
    found = spark.read.parquet(layout.at).inputFiles()
    return sorted((int(re.search(r"/part-(\d+)-[^/]*$", path)[1]), path) for path in found)


def erase(layouts: list[Layout], at: str) -> DataFrame:
    """Rewrite the files that hold victims; one row for every file that is left.

    ``table_name``, ``file_no``, ``n_rows``, ``n_erased``, ``cents``, ``ids_sha256`` (of the first column), ``rewritten``, ``columns``,
    ``path``. A task takes a file, as its rows are digested in their order, and holds a row group of it at most. New
    versions are written beside the old ones; only when all are complete, and known, do they take their
    places, so that a lost executor costs no more than the files it was writing.
    """
    spark = layouts[0].ranked.sparkSession
    files = [(x.name, no, path, x.columns, x.cents_of) for x in layouts for no, path in written_files(spark, x)]
    schema = "table_name string, file_no long, path string, columns array<string>, cents_of string"
    if not files:
        return spark.createDataFrame([], "table_name string, file_no long, n_rows long, n_erased long, cents long, ids_sha256 string, rewritten boolean, columns string, path string")
    spans = [intervals(x.ranked.filter("__tw_victim"), x.per_file).withColumn("table_name", F.lit(x.name)) for x in layouts]
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    todo = spark.createDataFrame([(*f, k) for k, f in enumerate(files)], f"{schema}, k int").join(every, ["table_name", "file_no"], "left")
    work = f"{at}/new"
    done = cut(map_arrow(todo.repartitionById(len(files), F.col("k")), lambda batches: _rewrite(batches, work), "table_name string, file_no long, path string, new string, n_rows long, n_erased long, cents long, ids_sha256 string"))

    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    final = []
    for r in done.collect():  # a row a file
        path = r["path"]
        if r["new"]:
            path = re.sub(r"[^/]*$", f"part-{r['file_no']:05d}-{uuid.uuid4().hex}-erased.parquet", path)
            if not fs.rename(path_of(r["new"]), path_of(path)):
                raise OSError(f"{r['new']} could not be moved to {path}")
        if r["n_erased"]:
            fs.delete(path_of(r["path"]), False)
        if r["n_rows"]:
            final.append((r["table_name"], r["file_no"], path))
    removed(spark, work)
    named = spark.createDataFrame(final, "table_name string, file_no long, final string")
    columns = F.create_map(*[F.lit(y) for x in layouts for y in (x.name, ",".join(x.columns))])
    out = done.join(F.broadcast(named), ["table_name", "file_no"])
    return out.select("table_name", "file_no", "n_rows", "n_erased", "cents", "ids_sha256", (F.col("n_erased") > 0).alias("rewritten"), columns[F.col("table_name")].alias("columns"), F.col("final").alias("path"))


def cascade(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, modulus: int = MODULUS, files: int = FILES) -> DataFrame:
    """Lay out the four tables in a new folder under ``spark.checkpoint.dir``, erase the victims, return a row per file that is left (see :func:`erase`).

    Victims are the clients of the masters whose crc32 (of the decimal) ``modulus`` divides, and of the one with most
    clicks, these clients' clicks and sales, and the lines of these sales. Null ids link nothing; rows with a null
    client_id, and lines without a sale, sort first. Repeated rows are rows of their own. An empty table has no files.
    Columns beyond the known ones are sorted by and written like the others; names that begin with ``__tw_`` are reserved. An amount that
    is null or not finite counts nothing.
    """
    spark = clients.sparkSession
    at = f"{shared_folder(spark)}/erasure/{uuid.uuid4().hex}"
    money = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
    with scratch(spark):  # sorted runs and ranks are of no use later
        tables = keyed(clients, clicks, sales, sale_lines, modulus)
        left = erase([lay_out(df, name, at, money[name], files) for name, df in tables.items()], at)
        rows = left.collect()  # a row a file, FILES a table at most
    return spark.createDataFrame(rows, left.schema)


_DONE = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("path", pa.string()), ("new", pa.string()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())])
