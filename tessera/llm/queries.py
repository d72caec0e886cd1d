"""Thin queries over the operators of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, minhash, mixing, packed_ids, pii, quality_classifier, quality_rules, repeats, toxicity, vectors
from .common import read_table


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(read_table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(read_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(read_table(spark, sf_dir, "documents"))


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.written_and_read(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": op1_vectors,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing": op8_mixing,
    "op9_repeats": op9_repeats,
    "op10_packed_ids": op10_packed_ids,
}
ORACLES: dict[str, str] = {"op1_vectors": vectors.ORACLE_SQL, "op6_minhash": minhash.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op9_repeats": repeats.ORACLE_SQL}
