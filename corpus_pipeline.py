"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing of sources, tokens.

Each stage works on all documents that the one before kept and returns the columns of documents, but the last, which
returns the tokens. Stages are written as Parquet in the shared store and read again, so a lost executor costs one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, minhash, mixing, pii, quality_rules
from tessera.llm.common import materialise, read_table, release


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles, link by link."""
    return minhash.deduplicate(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all up to three times."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), their hash, and the hash of the text decoded from them."""
    return bpe.round_trip_digests(docs, with_ids=True)


STAGES = [
    ("quality rules", reject_by_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("tokens", encode_tokens),
]

#: Component search and byte-pair merging have no SQL of reasonable cost; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that the stages leave, one row for each time the mix takes one.

    A stage's table is removed once the next one is written. Defined results: null and empty texts fail the quality
    rules and go; a null lang or source is a group of its own; a document without doc_id is kept, never a duplicate,
    and its row has a null doc_id; of repeated rows one stays, unless they have no doc_id; very long texts are worked
    on whole; an empty table, or one of which the rules keep nothing, gives no rows; further columns, whatever they
    are called, go along until the tokens.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
