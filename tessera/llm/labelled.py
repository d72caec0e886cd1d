"""Bounded samples of labelled and unlabelled texts for the classifiers, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_or_null


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, divisible by 5. Null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Most bytes of texts that a sample may bring to the driver.
SAMPLE_BYTES = 32 << 20


def _order() -> list[Column]:
    return [F.xxhash64("doc_id"), F.col("doc_id")]


def _texts_of(documents: DataFrame, ids: DataFrame, *more: str) -> list[dict]:
    """One text for each of the (bounded) ids, whole, and no more of them than SAMPLE_BYTES hold, in the ids' hash order.

    Rows of one id count once, with the least text by hash; sizes are read first, so that texts beyond the bound never
    leave the executors.
    """
    docs = columns_or_null(documents, {"doc_id": "long", "text": "string"}).join(F.broadcast(ids), "doc_id")
    least = F.struct(F.xxhash64("text").alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    sizes = docs.groupBy("doc_id").agg(F.min(least).alias("t")).select("doc_id", "t.*").orderBy(*_order()).collect()  # a row an id
    chosen, held = [], 0
    for r in sizes:
        held += r["size"]
        if held > SAMPLE_BYTES:
            break
        chosen.append((r["doc_id"], r["h"]))
    if not chosen:
        return []
    wanted = documents.sparkSession.createDataFrame(chosen, "_id long, _h long")
    found = docs.join(F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))).select("doc_id", "text", *more).dropDuplicates(["doc_id"])
    return sorted(found.toArrow().to_pylist(), key=lambda r: r["doc_id"])  # the order of training is that of the ids


def labelled_texts(documents: DataFrame, labels: DataFrame, column: str, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of up to per_class training ids of each label, chosen by a hash of their ids.

    The bound makes the ids small enough to broadcast. Repeated labels count once; ids with contradicting labels are
    left out, as are labels other than 0 and 1.
    """
    known = columns_or_null(labels, {"doc_id": "long", column: "int"}).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(column).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_most")).where(F.col(column) == F.col("_most")).drop("_most")
    part = lambda y: known.where(F.col(column) == y).orderBy(*_order()).limit(per_class)
    return [(r["text"] or "", r[column]) for r in _texts_of(documents, part(0).union(part(1)), column)]


def web_texts(documents: DataFrame, rows: int) -> list[str]:
    """Up to rows unlabelled texts of the training fold, chosen by a hash of their ids."""
    ids = columns_or_null(documents, {"doc_id": "long"}).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(*_order()).limit(rows)
    return [r["text"] or "" for r in _texts_of(documents, ids)]
