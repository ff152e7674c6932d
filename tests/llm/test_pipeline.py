"""The pipeline over fixture documents: what each stage keeps."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm import tables
from tidewell.llm import quality_rules, simhash


def brute_survivors(texts):
    """Ids that stay: the smallest of each group that pairs with a Jaccard similarity of 0.8 over five-word shingles form."""
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                u, v = top(a), top(b)
                root[max(u, v)] = min(u, v)
    return {i for i in ids if top(i) == i}


def test_near_dedup_equals_brute_force(spark, sf):
    """Near copies with few and many edits: what stays is what all pairs give, but for pairs close to the threshold."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng, texts = random.Random(4), dict(docs)
    for n, (i, t) in enumerate(docs):
        w = (t or "").split()
        if len(w) >= 30:
            for share in (0.005, 0.02, 0.04):
                edited = [x if rng.random() > share else f"new{rng.random()}" for x in w]
                texts[10_000 + 10 * n + int(share * 100)] = " ".join(edited)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in simhash.deduplicated(df).select("doc_id").collect()}
    expected = brute_survivors(texts)
    gone = set(texts) - expected
    assert expected <= got  # nothing else goes
    assert len(gone & got) <= 0.03 * len(gone) and len(gone) > 150


def test_stages_keep_the_columns_of_documents(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, rows = docs.columns, docs.collect()
    seen = {r.doc_id: r.text for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names and len(ids) == len(set(ids)) and set(ids) <= set(seen)
        if name == "quality rules":
            kept = {r.doc_id for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
            assert set(ids) == kept
        if name == "SimHash near-dedup":
            assert set(ids) == brute_survivors({r.doc_id: r.text for r in docs.collect()})
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts))  # no exact copies are left
            assert {r.text for r in docs.collect()} >= set(texts)
        if name == "secret scans":
            assert len(ids) == docs.count()
            assert not any(re.search(r"token = .?[0-9a-f]{24,}", r.text) for r in after.collect())
        if name == "best-fit packing":
            assert set(ids) == {r.doc_id for r in docs.collect()}
        docs = after


def test_run_gives_the_last_stage(spark, sf):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "bin_id", "offset", "n_tokens"} <= set(got.columns) and got.count() > 0


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_run_on_odd_tables(spark, tmp_path, which):
    """Nulls, repeats, long and empty texts go through all stages; what is packed is what the stages kept."""
    docs = tables.table(spark, which)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tables.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = corpus_pipeline.apply_quality_rules(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept.collect()}
    assert bool(got) == (which == "odd")
