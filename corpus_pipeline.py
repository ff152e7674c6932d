"""The corpus pipeline: stages over ``documents``, each written and read again as Parquet.

Every stage works on all rows its predecessor kept and its decisions take effect: rejected
documents go, one document of each near-duplicate group stays, secrets are replaced in the
texts, sources are sampled to target weights, and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.lineage import removed, scratch, shared_folder
from tidewell.llm import mixing, packing, quality_rules, secret_scan, simhash
from tidewell.llm.common import table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Nulls, empty texts and tables: see quality_rules."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more over five-word shingles.

    Short SimHashes of parts of a text's set of shingles (bands) find candidates, 256-bit SimHashes and then the exact
    similarity of the sets decide: at 0.8 no radius on whole fingerprints leaves tiles out, see README.

    Null and empty texts are one group; documents with a null doc_id stay; of rows with one doc_id one
    stays. Repeated rows are copies. An empty table stays empty."""
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by marks. Null texts stay null, an empty table empty."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered weights of source, language and topic; texts without words go.

    Null sources and languages count as the empty string, documents with a null doc_id share one draw. An empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of bounded length.

    Null and empty texts have one piece of one token; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", replace_secrets),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_documents),
]

#: SimHash and the sequential packing have no SQL form; tests hold the rows against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results in between are written to the shared folder, and deleted once the next one is there."""
    at = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        if k:
            removed(spark, f"{at}/{k - 1}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
