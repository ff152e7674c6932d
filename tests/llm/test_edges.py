"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tidewell.llm import mixing, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash, substring_dedup, token_counts, weighted_sampling


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OPERATORS = {
    "quality_rules": lambda d, l: quality_rules.quality_rules(d, l),
    "secret_scan": lambda d, l: secret_scan.scan(d),
    "simhash": lambda d, l: simhash.near_duplicates(d, 3, 2, 1),
    "simhash_similarity": lambda d, l: simhash.near_duplicates(d),
    "sharding": lambda d, l: sharding.shards(d),
    "mixing": lambda d, l: mixing.mix(d),
    "weighted_sampling": lambda d, l: weighted_sampling.edited_fingerprints(d),
    "token_counts": lambda d, l: token_counts.token_counts(d, vocabulary()),
    "quality_classifier": lambda d, l: quality_classifier.classify(d, quality_classifier.train(d, l)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    docs, labels = tables.table(spark), tables.labels(spark)
    got = OPERATORS[name](docs, labels).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in tables.rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_empty_labels(spark, name):
    assert OPERATORS[name](tables.table(spark, "empty"), tables.labels(spark, "empty")).count() == 0
    assert OPERATORS[name](tables.table(spark, "empty"), tables.labels(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = OPERATORS[name](tables.table(spark), tables.labels(spark))
    extra = OPERATORS[name](tables.table(spark, "extra"), tables.labels(spark))
    assert sorted(map(str, plain.collect())) == sorted(map(str, extra.collect()))


def test_packing_covers_all_and_bounds_bins(spark):
    docs = tables.table(spark)
    got = packing.pack(docs, capacity=512).collect()
    assert {r.doc_id for r in got} == {r[0] for r in tables.rows()}
    assert packing.pack(tables.table(spark, "empty")).count() == 0
    assert sorted(map(str, packing.pack(tables.table(spark, "extra"), capacity=512).drop("bin_id").collect())) == sorted(map(str, packing.pack(docs, capacity=512).drop("bin_id").collect()))


def test_passages_of_odd_tables(spark):
    got = substring_dedup.repeated_passages(tables.table(spark)).collect()
    ids = {r.doc_id for r in got}
    assert {1, 2, 3, 15} <= ids and not ids & {4, 5, 6, 7, 8, 9, None}
    assert substring_dedup.repeated_passages(tables.table(spark, "empty")).count() == 0
    assert len(substring_dedup.repeated_passages(tables.table(spark, "extra")).collect()) == len(got)


def test_filters_keep_all_columns(spark):
    docs, labels = tables.table(spark, "extra"), tables.labels(spark)
    for got in (quality_rules.kept_documents(docs, labels), simhash.deduplicated(docs), secret_scan.redacted(docs), mixing.mixed_documents(docs), substring_dedup.deduplicated(docs)):
        assert got.columns == docs.columns
        assert got.count() > 0
    empty = tables.table(spark, "empty")
    for got in (quality_rules.kept_documents(empty, labels), simhash.deduplicated(empty), secret_scan.redacted(empty), mixing.mixed_documents(empty), substring_dedup.deduplicated(empty)):
        assert got.count() == 0


def test_defined_results(spark):
    docs, labels = tables.table(spark), tables.labels(spark)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(not rules[i].kept and rules[i].n_words == 0 for i in (4, 5, 6))
    sim = {r.doc_id: r for r in simhash.near_duplicates(docs, 3, 2, 1).filter("doc_id is not null").collect()}
    assert {sim[i].component_id for i in (4, 5, 6)} == {4} and sim[4].fp == [0]
    assert sim[1].component_id == sim[3].component_id == 1
    assert simhash.near_duplicates(docs).filter("doc_id is null and component_id is not null").count() == 0
    scores = {r.doc_id: r for r in quality_classifier.classify(docs, quality_classifier.train(docs, tables.labels(spark, "empty"))).collect()}
    assert {r.score for r in scores.values()} == {0.5} and {r.predicted for r in scores.values()} == {1}
    tokens = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary()).collect()}
    assert all((tokens[i].n_tokens, tokens[i].over_limit) == (0, False) for i in (4, 5, 6))
    near = {r.doc_id: r for r in weighted_sampling.edited_fingerprints(docs).collect()}
    assert near[1].fingerprint == near[2].fingerprint != near[14].fingerprint
    assert set(near[4].fingerprint) == {"0"} and near[4].near_edited == 1.0
    mixed = mixing.mix(docs).filter(F.col("n_tokens") == 0).select("kept", "probability").distinct().collect()
    assert [tuple(r) for r in mixed] == [(False, 0.0)]
