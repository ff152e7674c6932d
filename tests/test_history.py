"""Dedup over all history across batches, restarts and kills, against a set."""

import random
from datetime import datetime, timedelta

import pytest

from tidewell.sources import versions
from tidewell.streaming import history, pipelines

SCHEMA = "title string, url string, collected_at timestamp"


def test_restarts_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    items, at, path, r = str(tmp_path / "items"), str(tmp_path / "at"), str(tmp_path / "t"), random.Random(1)
    seen, commit = set(), versions._commit

    def drain():
        pipelines.each_batch(pipelines.files(spark, items, SCHEMA), at, history.ingest(path)).awaitTermination()

    for k in range(5):
        day = datetime(2024, 1, 1) + timedelta(days=90 * k)  # far beyond any watermark
        rows = [(f"t{r.randrange(60)}", "u", day + timedelta(seconds=i)) for i in range(40)]
        seen |= {x[0] for x in rows}
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(items)
        if k in (1, 3):  # killed before the commit in one round, after it (but before the stream's own) in another

            def killed(*args, k=k):
                if k == 3:
                    commit(*args)
                raise RuntimeError("killed")

            monkeypatch.setattr(versions, "_commit", killed)
            with pytest.raises(Exception, match="killed"):
                drain()
            monkeypatch.undo()
        drain()
        got = [x.title for x in versions.read(spark, path).collect()]
        assert sorted(got) == sorted(seen)
    assert versions.current(spark, path).watermark == 4


def test_the_first_of_a_batch_stays(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 1, "w"), ("b", 1, "v")]
    batch = spark.createDataFrame(rows, "k string, at int, v string")
    assert sorted(x.v for x in history.unseen(batch, None, "k", ["at"]).collect()) == ["v", "w", "y"]
    assert sorted(x.v for x in history.unseen(batch, batch.filter("k = 'b'"), "k", ["at"]).collect()) == ["w", "y"]
