"""Cascading erasure against plain sorting and filtering, file by file."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, erasure

MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def ordered(value):
    return (value is not None, (isinstance(value, float) and math.isnan(value), 0 if isinstance(value, float) and math.isnan(value) else value) if value is not None else 0)


def brute(tables, modulus, files):
    """{(table, file_no): (rows that stay, number erased)} of files that are left."""
    seen = Counter(r["client_id"] for r in tables["clicks"] if r["client_id"] is not None)
    own = {}
    for r in tables["clients"]:
        if r["master_id"] is not None:
            own.setdefault(r["master_id"], set()).add(r["client_id"])
    masters = {m for m in own if crc(m) % modulus == 0}
    if own:
        masters.add(min(own, key=lambda m: (-sum(seen[c] for c in own[m]), m)))
    people = {r["client_id"] for r in tables["clients"] if r["master_id"] in masters} - {None}
    sales = {r["sale_id"] for r in tables["sales"] if r["client_id"] in people} - {None}
    buyer = {r["sale_id"]: r["client_id"] for r in tables["sales"]}
    victim = {"clients": lambda r: r["master_id"] in masters, "sale_lines": lambda r: r["sale_id"] in sales}
    out = {}
    for name, rows in tables.items():
        key = (lambda r: buyer.get(r["sale_id"]) if r["sale_id"] is not None else None) if name == "sale_lines" else (lambda r: r["client_id"])
        rows = sorted(rows, key=lambda r: (crc(key(r)), *map(ordered, r.values())))
        size = 1 + len(rows) // files
        for no in range(-(-len(rows) // size)):
            part = rows[no * size : (no + 1) * size]
            left = [r for r in part if not victim.get(name, lambda r: r["client_id"] in people)(r)]
            if left:
                out[name, no] = (left, len(part) - len(left))
    return out


def held_against_brute(got, tables, modulus, files):
    want = brute(tables, modulus, files)
    assert sorted((r.table_name, r.file_no) for r in got) == sorted(want)
    for r in got:
        left, erased = want[r.table_name, r.file_no]
        ids = ",".join("" if (v := next(iter(x.values()))) is None else str(v) for x in left)
        cents = sum(math.floor(100 * v + 0.5) for x in left if (v := x[MONEY[r.table_name]]) is not None and math.isfinite(v))
        assert (r.n_rows, r.n_erased, r.cents, r.rewritten, r.columns, r.ids_sha256) == (len(left), erased, cents, erased > 0, ",".join(left[0]), hashlib.sha256(ids.encode()).hexdigest())
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        assert str(file.read().to_pylist()) == str(left)
        numbers = [v for x in left if (v := next(iter(x.values()))) is not None]
        groups = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        if numbers:
            assert (min(s.min for s in groups if s.has_min_max), max(s.max for s in groups if s.has_min_max)) == (min(numbers), max(numbers))
    if got:
        base = os.path.dirname(os.path.dirname(got[0].path.removeprefix("file:")))
        assert sum(f.endswith(".parquet") for _, _, found in os.walk(base) for f in found) == len(got)


def frames(spark, tables, schemas):
    return [spark.createDataFrame([tuple(r.values()) for r in tables[n]], schemas[n]) for n in MONEY]


def test_fixture_tables(spark, sf):
    read = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in MONEY}
    tables = {n: [r.asDict() for r in df.collect()] for n, df in read.items()}
    held_against_brute(erasure.cascade(*read.values()).collect(), tables, 100, 150)


SCHEMAS = {
    "clients": "client_id long, master_id long, balance double, __file string", "clicks": "click_id long, client_id long, ts timestamp_ntz, value double",
    "sales": "sale_id long, client_id long, total double, n_rows int", "sale_lines": "sale_id long, line_no int, amount double, rank string",
}


def odd(seed, hot=False):
    r = random.Random(seed)
    some = lambda *v: r.choice([None, *v])
    client = lambda: 7 if hot and r.random() < 0.4 else some(*range(40))
    money = lambda: some(1.005, -2.5, 0.0, math.nan, math.inf, 12.345)
    clients = [{"client_id": some(i), "master_id": some(i // 2, 3), "balance": money(), "__file": some("x", "")} for i in range(40)]
    clicks = [{"click_id": some(i, 5), "client_id": client(), "ts": some(datetime(2024, 1, 1 + i % 28)), "value": money()} for i in range(700)]
    sales = [{"sale_id": i if i % 9 else None, "client_id": client(), "total": money(), "n_rows": some(1, 2)} for i in range(200)]
    lines = [{"sale_id": 4 if hot and i % 3 == 0 else some(*range(220)), "line_no": some(1, 2), "amount": money(), "rank": some("b", "ä")} for i in range(900)]
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}


@pytest.mark.parametrize(("seed", "hot", "modulus", "files"), [(1, False, 5, 7), (2, True, 3, 40), (3, True, 10**9, 150)])
def test_odd_tables(spark, seed, hot, modulus, files, monkeypatch):
    tables = odd(seed, hot)
    monkeypatch.setattr(erasure, "BLOCK", 13)
    got = erasure.cascade(*frames(spark, tables, SCHEMAS), modulus, files).collect()
    held_against_brute(got, tables, modulus, files)


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    tables = odd(4, True)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "small", lambda df, *_: df)
    held_against_brute(erasure.cascade(*frames(spark, tables, SCHEMAS), 4, 20).collect(), tables, 4, 20)


def test_empty_tables(spark):
    tables = odd(5)
    for empty in (["clicks"], ["clients"], ["sales", "sale_lines"], list(MONEY)):
        some = {n: [] if n in empty else rows for n, rows in tables.items()}
        held_against_brute(erasure.cascade(*frames(spark, some, SCHEMAS), 5, 9).collect(), some, 5, 9)


def test_intervals_split_and_join(spark):
    r = random.Random(6)
    ranks = sorted(r.sample(range(400), 230)) + [*range(500, 560)]
    found = erasure.intervals(spark.createDataFrame([(x,) for x in ranks], "__tw_rank long"), 37, block=10).collect()
    for row in found:
        held = [x - 37 * row.file_no for x in ranks if x // 37 == row.file_no]
        assert [x for s in row.spans for x in range(s.lo, s.hi + 1)] == held
        assert all(a.hi + 1 < b.lo for a, b in zip(row.spans, row.spans[1:]))
        kept = erasure.surviving(37, [(s.lo, s.hi) for s in row.spans])
        assert [x for a, b in kept for x in range(a, b)] == [x for x in range(37) if x not in held]
    assert {row.file_no for row in found} == {x // 37 for x in ranks}


def test_slices_share_buffers():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(100))})
    parts = list(erasure.slices(iter([batch.slice(0, 60), batch.slice(60)]), [(3, 5), (10, 80), (99, 100)]))
    assert [v for p in parts for v in p.column(0).to_pylist()] == [3, 4, *range(10, 80), 99]
    assert all(p.column(0).buffers()[1].address == batch.column(0).buffers()[1].address for p in parts)


def test_victim_master_ties(spark):
    clients = spark.createDataFrame([(1, 9), (2, 4), (3, None)], "client_id long, master_id long")
    none = spark.createDataFrame([], "client_id long")
    assert erasure.victim_master(clients, none) == 4
    assert erasure.victim_master(clients, spark.createDataFrame([(1,), (3,), (3,)], "client_id long")) == 9
    assert erasure.victim_master(clients.filter(F.lit(False)), none) is None
