"""Decontamination against plain window lookups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tidewell.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[a : a + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(d, i).collect()
    assert all((r.n_items, r.contaminated) == (len(r["items"]), r.n_hit > 0) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str)


def test_fixture_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_random_passages_of_every_length(spark, letters):
    """Few letters give equal hashes and repeats; items of one to forty words, pasted in whole and in part, at any place."""
    r = random.Random(len(letters))
    word = lambda: "".join(r.choice(letters) for _ in range(r.choice((1, 2, 5))))
    items = [(i % 37, " ".join(word() for _ in range(n))) for i, n in enumerate([*range(3, 41)] * 2)]
    docs = []
    for k in range(120):
        w = [word() for _ in range(r.choice((0, 2, 9, 10, 30, 200)))]
        for _ in range(r.choice((0, 1, 3))):
            item = split(r.choice(items)[1])
            a = r.randrange(len(item))
            at = r.randrange(len(w) + 1)
            w[at:at] = item[a : a + r.choice((9, 10, 11, 40))] if r.random() < 0.5 else item
        docs.append((k, r.choice((" ", ", ", "\n-- ")).join(w).upper() if k % 3 == 0 else " ".join(w)))
    assert run(spark, docs, items) == brute(docs, items)


def test_only_whole_windows_hit(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + ten + " y"), (2, ten.rsplit(" ", 1)[0]), (3, ten.replace("five", "cinq")), (4, "ÉTÉ une fois"), (5, "Été une fois"), (6, ten.replace(" ", "\x01_")), (7, "n1 2k")]
    items = [(1, ten), (2, "Été une"), (3, "2K"), (4, "one two"), (None, "one two three"), (5, ""), (6, None), (7, "?!")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    by = {r[0]: r for r in got}
    assert by[1][2:] == (10, ["1", "4"]) and by[2][2:] == (3, ["4"]) and by[4][2] == 0 and by[5][2:] == (2, ["2"]) and by[6][2] == 10 and by[7][2:] == (1, ["3"])


def test_odd_and_empty_tables(spark):
    docs = [(r[0], r[1]) for r in tables.rows()]
    items = [(1, tables.text(3, 40)), (2, "two words"), (1, tables.text(1, 120)), (9, "Same " * 50)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = bench.withColumns({c: F.lit("clash") for c in ("window", "items", "length", "h", "doc_id")})
    plain = decontamination.decontaminate(tables.table(spark), bench).collect()
    extra = decontamination.decontaminate(tables.table(spark, "extra").withColumns({"h": F.lit(1), "items": F.lit(1), "digest": F.lit(1)}), clash).collect()
    assert sorted(map(str, plain)) == sorted(map(str, extra)) and len(plain) == len(docs)


def test_joins_without_broadcast_agree(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    broadcast = sorted(map(str, decontamination.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontamination, "HIT_ROWS", 0)
    assert sorted(map(str, decontamination.decontaminate(docs, items).collect())) == broadcast
