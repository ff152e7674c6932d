"""Versions: kills between the steps, races, batches, watermarks."""

import pytest
from pyspark.sql import functions as F

from tidewell.sources import versions


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def ids(spark, path):
    df = versions.read(spark, path)
    return None if df is None else sorted(r.id for r in df.collect())


def test_replace_and_kills(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert ids(spark, path) is None and versions.current(spark, path) == versions.Version(0)
    versions.replace(rows(spark, 1, 2), path)
    monkeypatch.setattr(versions, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # staged, not committed
        versions.replace(rows(spark, 3), path, 9)
    monkeypatch.undo()
    assert ids(spark, path) == [1, 2] and versions.current(spark, path).watermark is None
    bad = rows(spark, 5).withColumn("v", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        versions.replace(bad, path)
    assert ids(spark, path) == [1, 2]
    versions.replace(rows(spark, 4), path, 7)
    assert ids(spark, path) == [4] and versions.current(spark, path).watermark == 7
    gone = versions.vacuum(spark, path)
    assert len(gone) >= 2 and ids(spark, path) == [4] and versions.vacuum(spark, path) == []


def test_only_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    base = versions.current(spark, path)
    versions.append(rows(spark, 1), path, 1, base)
    with pytest.raises(versions.Conflict):
        versions.append(rows(spark, 2), path, 2, base)
    assert ids(spark, path) == [1] and versions.current(spark, path).watermark == 1


def test_copy_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path, source, commit, done = str(tmp_path / "t"), rows(spark, *range(0, 40, 3)), versions._commit, []

    def failing(*args):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(args)
        commit(*args)

    monkeypatch.setattr(versions, "_commit", failing)
    with pytest.raises(KeyboardInterrupt):
        versions.copy_table(source, path, "id", 4)
    monkeypatch.undo()
    assert ids(spark, path) == list(range(0, 24, 3))
    assert versions.copy_table(source, path, "id", 4) == 6
    assert ids(spark, path) == list(range(0, 40, 3)) and versions.copy_table(source, path, "id", 4) == 0


def test_watermark_moves_with_the_result_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    items = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00") for i in range(1, 8)], "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    versions.harvest(items, path, "at", "2024-01-02 00:00:00", lambda d: d)
    versions.harvest(items, path, "at", "2024-01-03 00:00:00", lambda d: d.filter("id > 100"))  # empty, moves nevertheless
    with pytest.raises(Exception, match="no answer"):
        versions.harvest(items, path, "at", "2024-01-06 00:00:00", lambda d: d.withColumn("id", F.raise_error(F.lit("no answer")).cast("long")))
    assert versions.current(spark, path).watermark == "2024-01-03 00:00:00"
    versions.harvest(items, path, "at", "2024-01-06 00:00:00", lambda d: d)
    assert ids(spark, path) == [1, 2, 4, 5, 6]
