"""Near-duplicate documents by MinHash (operator 6).

1. A sketch of each document: its distinct word shingles, a 128-bit name of the set, and the keys of the bands of
   its signature (the minima of many universal hash functions). No shuffle.
2. Documents with the same set form a class, a numbered node; the smallest doc_id represents it. Copies, however many,
   meet here and nowhere else.
3. Classes that share a band key stand in one bucket. Every class is verified against the first one of each of its
   buckets: signatures first, then the full sets. Large-star and small-star join the links to components.
4. A bucket whose classes are in one component has nothing more to tell: that ends all groups of near copies, however
   large, after work in proportion to their size. The other buckets of three or more are cut into blocks of bounded
   rows and bytes; each pair of blocks is one task, which looks at the pairs of different components that share no
   earlier band: at their signatures first, then, for the classes that may still link, at their full sets, as products
   of 0/1 matrices over the shingles that occur twice. A task returns a star for each local component, so neither
   candidate pairs nor links are ever rows, and no pair of a bucket goes unchecked.
5. Components over all links.

Defined results: null or empty texts, and texts without words, have no shingles, link with nothing and are kept; a
text with fewer words than a shingle has its whole sequence as its only shingle; a null doc_id links with nothing and
has a null component; rows of one doc_id with different texts are different documents, each in its own component, and
all have the smallest doc_id of theirs; further columns are ignored by near_duplicates() and kept by deduplicate(),
which keeps one row of each component, also where rows are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, map_arrow, materialise, release, text_input, text_slices
from .components import components
from .shingles import MinHash, band_keys, set_ids, shingle_sets, utf8

#: A pair at similarity 0.8 shares none of 32 bands of 5 minima with probability 3e-6.
BANDS, ROWS = 32, 5
#: Signatures agreeing on less than this much below the threshold (over five standard deviations) end a check.
SIGNATURE_MARGIN = 0.2
#: Mean rows and most bytes of sets in a block of a group; shingles that are compared at a time.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_SHINGLES = 512, 16 << 20, 4096

SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])
PLACED = T.StructType([*[T.StructField(c, T.LongType()) for c in ("bucket", "i", "j", "block", "node", "label", "least")]])
EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array's rows as binary values."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def sketch(documents: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(BANDS * ROWS)
        for batch in batches:
            for b in text_slices(batch):
                values, sizes = shingle_sets(*utf8(b.column(1)), words)
                keys = band_keys(minima(values, sizes), BANDS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(sizes), pa.array(set_ids(values, sizes), pa.binary()), lists], SKETCH.names)

    return map_arrow(text_input(documents.withColumn("text_hash", F.xxhash64("text")), "text_hash"), run, SKETCH)


def full_sets(documents: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(BANDS * ROWS)
        for batch in batches:
            for b in text_slices(batch):
                values, sizes = shingle_sets(*utf8(b.column(1)), words)
                ends = np.cumsum(sizes)
                raw = [values[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, sizes), pa.binary()), _binary(minima(values, sizes)), pa.array(sizes), pa.array(raw, pa.binary())], SETS.names)

    return map_arrow(text_input(documents), run, SETS)


def likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, signature, other_signature) -> the pairs (u, v) whose signatures may belong to a link."""
    for b in batches:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (2, 3))
            maybe = pa.array((one == two).mean(1) >= percent / 100 - SIGNATURE_MARGIN)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(maybe), b.column(1).filter(maybe)], EDGES.names)


def verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, shingles, other_shingles) -> the links (u, v) among them."""
    for b in batches:
        found = []
        for k in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                found.append(k)
        some = pa.array(found, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some)], EDGES.names)


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int, maybe: np.ndarray) -> np.ndarray:
    """Which of one block's sets (rows) link with which of another's (columns), of the pairs that maybe marks.

    100 * intersection >= percent * union.
    """
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    least, most = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
    maybe = maybe & (100 * least >= percent * most)
    out = np.zeros(maybe.shape, bool)
    rows, columns = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return out
    values = np.concatenate([*(a[i] for i in rows), *(b[j] for j in columns)])
    owner = np.repeat(np.arange(len(rows) + len(columns)), [*na[rows], *nb[columns]])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # shingles that occur once are in no intersection
    twice = (times > 1)[place]
    place, owner = number[place[twice]], owner[twice]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(rows), len(columns)), np.float64)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, BLOCK_SHINGLES):
        lo, hi = np.searchsorted(place, (first, first + BLOCK_SHINGLES))
        held = np.zeros((len(rows) + len(columns), BLOCK_SHINGLES), np.float32)
        held[owner[lo:hi], place[lo:hi] - first] = 1
        both += held[: len(rows)] @ held[len(rows) :].T
    union = np.add.outer(na[rows], nb[columns]) - both
    out[np.ix_(rows, columns)] = maybe[np.ix_(rows, columns)] & (both > 0) & (100 * both >= percent * union)
    return out


def local_roots(link: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node in a symmetric matrix of links."""
    root = np.arange(len(link))
    while True:
        near = np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link))
        after = np.minimum(root, near)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A task's rows in the order of their nodes, and the places of its two blocks."""
    table = table.combine_chunks().sort_by("node")
    block = table["block"].to_numpy()
    return table, np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())


def _maybe(table: pa.Table, rows: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of one pair of a bucket's blocks that may link and are not settled elsewhere."""
    ids, label = table["node"].to_numpy(), table["label"].to_numpy()
    bucket, least = table["bucket"][0].as_py(), table["least"][0].as_py()
    # pairs of one component, and pairs with the bucket's first class, are settled
    asked = (label[rows][:, None] != label[columns]) & (ids[rows] != least)[:, None] & (ids[columns] != least)
    if asked.any():
        signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(len(ids), -1)
        keys = band_keys(signatures, BANDS)
        for band in range(int(np.flatnonzero((keys == bucket).all(0))[0])):  # pairs that share an earlier band meet there
            asked &= keys[rows, band][:, None] != keys[columns, band]
    if asked.any():
        agree = np.zeros(asked.shape, np.uint16)
        for k in range(signatures.shape[1]):
            agree += signatures[rows, k][:, None] == signatures[columns, k]
        asked &= agree >= (percent / 100 - SIGNATURE_MARGIN) * signatures.shape[1]
    return asked


def block_candidates(table: pa.Table, percent: int) -> pa.Table:
    """The rows of one pair of blocks (PLACED and signature) that a link may join."""
    table, rows, columns = _sides(table)
    maybe = _maybe(table, rows, columns, percent)
    some = np.union1d(rows[maybe.any(1)], columns[maybe.any(0)])
    return table.select(PLACED.names + ["signature"]).take(pa.array(some, pa.int64()))


def block_stars(table: pa.Table, percent: int) -> pa.Table:
    """One pair of a bucket's blocks (PLACED, signature and shingles) -> stars of its links."""
    table, rows, columns = _sides(table)
    ids, root = table["node"].to_numpy(), np.arange(table.num_rows)
    maybe = _maybe(table, rows, columns, percent)
    if maybe.any():
        link = np.zeros((len(ids), len(ids)), bool)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        found = linked([sets[k] for k in rows], [sets[k] for k in columns], percent, maybe)
        link[np.ix_(rows, columns)] |= found
        link[np.ix_(columns, rows)] |= found.T
        root = local_roots(link)
    away = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"u": pa.array(ids[away], pa.int64()), "v": pa.array(ids[root[away]], pa.int64())})


def first_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes and the first classes of their buckets (bucket, node, least, n)."""
    pairs = buckets.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    side = lambda key, *columns: sets.select(F.col("node").alias(key), *columns)
    like = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    signed = pairs.join(side("u", "signature", "n"), "u").join(side("v", F.col("signature").alias("other"), F.col("n").alias("m")), "v").where(like)
    near = map_arrow(signed.select("u", "v", "signature", "other"), lambda batches: likely(batches, percent), EDGES)
    met = near.join(side("u", "shingles"), "u").join(side("v", F.col("shingles").alias("other")), "v")
    return map_arrow(met.select("u", "v", "shingles", "other"), lambda batches: verified(batches, percent), EDGES)


def open_links(buckets: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Stars (u, v) of the links of the buckets that known components (node, component) leave open."""
    labelled = buckets.where("n > 2").join(known, "node", "left").select("bucket", "node", "least", F.coalesce("component", "node").alias("label"))
    labelled = labelled.join(sets.select("node", F.col("n").alias("size")), "node")
    still = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"), F.sum("size").alias("shingles")).where("low <> high")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("long")
    still = still.select(F.col("bucket").alias("open"), blocks.alias("blocks"))
    placed = labelled.join(still, apart("bucket") == apart("open")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*PLACED.names)
    signed = T.StructType([*PLACED, T.StructField("signature", T.BinaryType())])
    some = placed.join(sets.select("node", "signature"), "node").select(*signed.names).groupBy("bucket", "i", "j").applyInArrow(lambda table: block_candidates(table, percent), signed)
    return some.join(sets.select("node", "shingles"), "node").groupBy("bucket", "i", "j").applyInArrow(lambda table: block_stars(table, percent), EDGES)


def _grouped(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a number, null without links or shingles) and component_id of every row."""
    sketches = materialise(sketch(documents, words), "sketch")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered as they are written
    banded = classes.select(F.explode("keys").alias("bucket"), "node")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select(F.col("bucket").alias("full"), "least", "n")
    buckets = materialise(banded.join(shared, apart("bucket") == apart("full")).select("bucket", "node", "least", "n"), "buckets")
    members = classes.select("node", "set_id", "rep").join(buckets.select("node").distinct(), "node")
    wanted = documents.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = materialise(full_sets(wanted, words).join(members.select("set_id", "node"), "set_id").drop("set_id").dropDuplicates(["node"]), "sets")
    firsts = materialise(first_links(buckets, sets, percent), "links")
    known = components(firsts)
    more = open_links(buckets, sets, known, percent)
    where = components(firsts.union(more))
    release(buckets, sets, firsts)
    met = classes.select("node", "rep").join(where, "node")
    least = met.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.col("component").alias("whole"), "component_id")
    met = met.join(least, apart("component") == apart("whole")).select("node", "component", "component_id")
    named = classes.select("set_id", "rep", "node").join(met, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    rows = sketches.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (whether that is its own)."""
    rows = _grouped(documents, words, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: one with its smallest doc_id. All columns stay.

    Rows are told apart by doc_id and a hash of the text; texts are not shuffled, but for rows that are repeated.
    """
    rows = materialise(_grouped(documents, words, percent), "groups")
    first = rows.where("component is not null and doc_id = component_id").groupBy("component").agg(F.min("text_hash").alias("stays"), F.count("*").alias("n"))
    several = materialise(first.where("n > 1").select("component", "stays"), "several")
    gone = rows.where("component is not null and doc_id <> component_id").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    is_row = (F.col("d") == F.col("_d")) & (F.col("h") == F.col("_h"))
    if not several.limit(1).count():
        return whole.join(gone, is_row, "left_anti").select("row.*")
    met = rows.join(several, "component").where("doc_id = component_id").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), (F.col("text_hash") == F.col("stays")).alias("stays")).distinct()
    once = whole.join(gone.union(met.select("_d", "_h")), is_row, "left_anti")
    again = whole.join(met.where("stays"), is_row, "left_semi").groupBy("d", "h").agg(F.first("row").alias("row"))
    return once.select("row.*").union(again.select("row.*"))


#: Pairs by their common shingles and components in one query, for four-word shingles and small tables of unique doc_ids.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
