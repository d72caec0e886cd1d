"""Exact removal of repeated byte strings (operator 9), by bucket-pointer refinement over sampled suffixes.

1. Suffixes are sampled: a 200-byte window is led by the smallest name of a LEAD-byte string inside it. Equal windows
   have equal leaders, and neighbouring windows share one, so a text becomes runs of windows, a few for a hundred bytes.
   The leaders' names deal the runs to buckets. Buckets of one run hold no repeated string and are dropped. (What a
   text repeats within itself is found where the text is, by sorting the names of its windows.)
2. Runs of equal content repeat each other whole; they are merged, so copies, however many, meet here and nowhere else.
   Only where runs of a bucket differ (at the ends of shared passages and at edits) one run of each content goes on.
3. Whole buckets of such runs are refined, many in one task: all suffixes of the runs stand in initial buckets by their
   first Q = 25 bytes; each pass sorts the suffixes of a bucket by the bucket pointers of the suffixes h bytes on and
   renumbers the buckets, which doubles h; the next pass reads the renewed pointers. A suffix alone in its bucket, or
   with such a one h bytes on, is repeated nowhere and leaves, so the passes shrink. Pointers are kept at exactly the
   same depth, as equality at 200 bytes is asked for and not an order of suffixes: three passes lead from 25 to 200.
4. A bucket of more than BUCKET_RUNS runs or BUCKET_BYTES bytes is no task's work. It is split by content first: into
   blocks of windows placed by their distance to the leader, dealt by the bytes that all windows of a block share, and
   merged like runs; what still differs is dealt window by window. Names at depth 200 are made there as pointers are,
   from those at half the depth, but from content, since equal strings must be named alike in all tasks. Two names of
   64 bits, made from different identifiers, must agree each time.

All sums are combined before they are shuffled, so neither common passages nor large groups of copies gather in a
task. Nothing is capped or sampled away: every window is in a run, and every run is compared.

Defined results: a null or empty text has no bytes and nothing to remove; matches never cross texts; rows with the
same doc_id are separate texts (they repeat each other); a null doc_id is a text like any other; further columns are
ignored by cut().
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _texts
from .common import apart, columns_or_null, map_arrow, materialise, release
from .shingles import _BYTE, _STEP, mix

Q, DEPTH = 25, 200
LEAD = 50
#: Windows of a text that are worked on at a time; longer texts are taken in overlapping parts.
PART = 1 << 20

#: Runs and bytes of a bucket that is refined in one task, and bytes of buckets that are refined together.
BUCKET_RUNS, BUCKET_BYTES, TOGETHER_BYTES = 4096, 2 << 20, 4 << 20

_rng = np.random.default_rng(77)
_C = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _joined(ids: np.ndarray, step: int, parts: int) -> np.ndarray:
    """Identifiers of parts * step bytes from those of step bytes at consecutive offsets."""
    n = len(ids) - step * (parts - 1)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = ids[:n] * _C[0]
    for k in range(1, parts):
        out += ids[k * step : k * step + n] * _C[k]
        out ^= out >> np.uint64(29)
    return mix(out)


def levels(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers at depths LEAD, DEPTH / 2 and DEPTH of all suffixes that are long enough for each."""
    ids = _joined(_joined(_BYTE[data], 1, 5), 5, 5)  # the initial buckets, by Q bytes
    held, depth = {}, Q
    while depth < DEPTH:
        ids = _joined(ids, depth, 2)
        depth *= 2
        held[depth] = ids
    return held[LEAD], held[DEPTH // 2], held[DEPTH]


def leaders(lead: np.ndarray, windows: int) -> np.ndarray:
    """The smallest identifier at depth LEAD in each window."""
    width, have = DEPTH - LEAD + 1, 1
    m = lead
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m[:windows]


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """leader, run identifier, first window and number of windows of the runs of one text, and spans it repeats itself."""
    n = len(data) - DEPTH + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, []
    lead, _, full = levels(data)
    led = leaders(lead, n)
    firsts = np.flatnonzero(np.append(True, led[1:] != led[:-1]))
    counts = np.diff(np.append(firsts, n))
    place = (np.arange(n) - np.repeat(firsts, counts)).astype(np.uint64)
    names = mix(np.add.reduceat(mix(full + place * _STEP), firsts) + counts.astype(np.uint64))
    ordered = np.sort(full)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    own = spans_of(np.flatnonzero(np.isin(full, again))) if len(again) else []
    return led[firsts].view(np.int64), names.view(np.int64), firsts, counts, own


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans of the windows at the given sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > DEPTH)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + DEPTH).tolist(), strict=True))


def _renumbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the keys that occur more than once, their buckets' new numbers, and how many buckets there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    held = np.repeat(sizes > 1, sizes)
    number = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    return order[held], number[held], int((sizes > 1).sum())


def refined(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the 200-byte strings that occur more than once in segments of bytes that end where ends says.

    The pointer of a suffix is the number of its bucket, -1 if it is alone in it.
    """
    n = len(data)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)
    names = _joined(_joined(_BYTE[data], 1, 5), 5, 5)
    at = np.flatnonzero(left[: len(names)] >= Q)
    place, number, buckets = _renumbered(names[at])
    at = at[place]
    pointer = np.full(n, -1, np.int64)
    pointer[at] = number
    depth = Q
    while depth < DEPTH:
        at = at[left[at] >= 2 * depth]
        later = pointer[at + depth]
        at, later = at[later >= 0], later[later >= 0]
        place, number, more = _renumbered(pointer[at] * buckets + later)
        at, buckets, depth = at[place], more, 2 * depth
        pointer = np.full(n, -1, np.int64)
        pointer[at] = number
    return np.sort(at)


# ---------------------------------------------------------------------------------------------------------------------
# Distributed steps

BLOCK = 16
RUNS = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.LongType()), T.StructField("row", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])
BLOCKS = T.StructType([*RUNS.fields, T.StructField("ids", T.ArrayType(T.LongType()))])
CUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
KEPT = T.StructField("kept", T.BinaryType())


def blocks(lead: np.ndarray, half: np.ndarray, full: np.ndarray, first: int, n: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """A run cut into blocks of up to BLOCK windows: key (of the bytes all windows of the block share), name, first, n, ids.

    A block is placed by its distance to the run's leader, so the same windows fall into the same block in every text.
    """
    led = lead[first : first + DEPTH - LEAD + 1].min()
    at = np.flatnonzero(lead[first : first + n + DEPTH - LEAD] == led) + first
    p = np.arange(first, first + n)
    leader = at[np.searchsorted(at, p)]
    away = leader - p
    cut = np.flatnonzero(np.append(True, (leader[1:] != leader[:-1]) | (away[1:] // BLOCK != away[:-1] // BLOCK)))
    named = mix(full[p] + (away % BLOCK).astype(np.uint64) * _STEP)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), n], strict=True):
        core = int(leader[a] - away[a] // BLOCK * BLOCK)
        key = mix(np.array([half[core] * _C[2] + half[core + DEPTH // 2 - BLOCK + 1] * _C[3]], np.uint64)).view(np.int64)[0]
        name = mix(named[a:b].sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)).view(np.int64)[0]
        yield int(key), int(name), int(p[a]), b - a, full[p[a:b]].view(np.int64)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _runs_of(rows: DataFrame) -> DataFrame:
    """row, text -> runs of every text; spans that a text repeats itself come with a null key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[], [], [], [], []]
            own: list[tuple[int, int, int]] = []
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                data = _bytes(text)
                for start in range(0, max(0, len(data) - DEPTH + 1), PART):
                    key, name, first, n, spans = runs(data[start : start + PART + DEPTH - 1])
                    for to, x in zip(held, (key, name, np.full(len(key), row), first + start, n), strict=True):
                        to.append(x)
                    own += [(row, start + a, b - a - DEPTH + 1) for a, b in spans]
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], RUNS.names)
            if own:
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *[pa.array([o[k] for o in own], pa.int64()) for k in range(3)]], RUNS.names)

    return map_arrow(rows, run, RUNS)


def _blocks_of(rows: DataFrame) -> DataFrame:
    """row, text, wanted (array of first, n) -> blocks of the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text, wanted in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), _texts(batch.column(2)), strict=True):
                data, done = _bytes(text), -1
                for w in sorted(wanted, key=lambda w: w["first"]):
                    start = w["first"] // PART * PART
                    if start != done:
                        part, done = data[start : start + PART + DEPTH - 1], start
                        lead, half, full = levels(part)
                    out += [(k, name, row, start + first, n, ids) for k, name, first, n, ids in blocks(lead, half, full, w["first"] - start, w["n"])]
                if len(out) > 20_000:
                    yield _block_rows(out)
                    out = []
            yield _block_rows(out)

    return map_arrow(rows, run, BLOCKS)


def _block_rows(out: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([0, *[len(o[5]) for o in out]], np.int32)
    flat = np.concatenate([o[5] for o in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([*[pa.array([o[k] for o in out], pa.int64()) for k in range(5)], pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))], BLOCKS.names)


def _merged_contents(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs (or blocks) by bucket: those repeated whole (row, first, n), and one of each content of the others.

    Returns covered, representatives (key, row, first, n and further columns), and the table behind both, to be released.
    """
    shared = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("c"), F.min("name").alias("low"), F.max("name").alias("high")).where("c > 1")
    shared = shared.select(F.col("key").alias("bucket"), "low", "high")
    met = materialise(rows.join(shared, apart("key") == apart("bucket")).drop("bucket"), "met")
    differ = met.where("low <> high")
    classes = differ.groupBy("key", "name").agg(F.count("*").alias("c"), F.min(F.struct("row", "first")).alias("r"))
    classes = materialise(classes, "classes")
    twice = differ.join(classes.where("c > 1").select("key", "name"), ["key", "name"], "left_semi")
    covered = met.where("low = high").select("row", "first", "n").union(twice.select("row", "first", "n"))
    one = classes.select("key", "name", "r.row", "r.first")
    return materialise(covered, "covered"), materialise(differ.join(one, ["key", "name", "row", "first"]).select("key", "row", "first", "n", *more).dropDuplicates(["key", "row", "first"]), "one"), met


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a name for the row: rows alike in both share their windows, and so their spans."""
    return columns_or_null(documents, {"doc_id": "long", "text": "string"}).withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


SEGMENTS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("key", "row", "first", "n")], T.StructField("bytes", T.BinaryType())])
COVERED = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "first", "n")])


def _segments_of(rows: DataFrame) -> DataFrame:
    """row, text, wanted (array of key, first, n) -> the bytes under the windows of the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text, wanted in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), _texts(batch.column(2)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(w["key"], row, w["first"], w["n"], data[w["first"] : w["first"] + w["n"] + DEPTH - 1]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((*[pa.int64()] * 4, pa.binary()))], SEGMENTS.names)

    return map_arrow(rows, run, SEGMENTS)


def _refined_together(table: pa.Table) -> pa.RecordBatch:
    """Whole buckets of segments -> stretches of windows that occur elsewhere."""
    raw = table["bytes"].to_pylist()
    ends = np.cumsum([len(x) for x in raw])
    at = refined(np.frombuffer(b"".join(raw), np.uint8), ends)
    cut = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(at) else np.zeros(0, np.int64)
    segment = np.searchsorted(ends, at[cut], side="right")  # windows end within their segment, so no stretch crosses one
    begins = ends - np.array([len(x) for x in raw], np.int64)
    first = table["first"].to_numpy()[segment] + at[cut] - begins[segment]
    return pa.RecordBatch.from_arrays([pa.array(table["row"].to_numpy()[segment]), pa.array(first), pa.array(np.diff(np.append(cut, len(at))).astype(np.int64))], COVERED.names)


def _bucket_windows(segments: DataFrame) -> DataFrame:
    """Refine every bucket (key) of the segments; a task takes whole buckets, some TOGETHER_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > TOGETHER_BYTES:
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if whole:
                    yield _refined_together(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield _refined_together(pa.Table.from_batches(held))

    return map_arrow(segments.repartition("key").sortWithinPartitions("key"), run, COVERED)


@contextlib.contextmanager
def _short_lived_shuffles(spark: SparkSession):
    """Drop the shuffle files of each written step as soon as it is written, where the session allows it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def covered_windows(documents: DataFrame) -> DataFrame:
    """row, first, n: stretches of windows that occur elsewhere, of all texts (row as in _keyed())."""
    spark = documents.sparkSession
    rows = _keyed(documents)
    with _short_lived_shuffles(spark):
        found = materialise(_runs_of(rows.select("row", "text")), "runs")
        whole, open_runs, met = _merged_contents(found)
        release(met)
        sizes = open_runs.groupBy("key").agg((F.count("*") > BUCKET_RUNS).alias("many"), F.sum(F.col("n") + DEPTH - 1).alias("size"))
        large = materialise(sizes.where(F.col("many") | (F.col("size") > BUCKET_BYTES)).select(F.col("key").alias("bucket")), "large")
        is_large = apart("key") == apart("bucket")
        texts = rows.select("row", "text")
        listed = lambda runs, *columns: texts.join(runs.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "row")
        refined_runs = materialise(_bucket_windows(_segments_of(listed(open_runs.join(large, is_large, "left_anti"), "key", "first", "n"))), "refined")
        parts = materialise(_blocks_of(listed(open_runs.join(large, is_large, "left_semi"), "first", "n")), "blocks")
        whole_blocks, open_blocks, met = _merged_contents(parts, "ids")
        release(met)
        windows = materialise(open_blocks.select("key", "row", "first", F.posexplode("ids").alias("k", "id")).select("key", "id", "row", (F.col("first") + F.col("k")).alias("first")).distinct(), "windows")
        twice = windows.groupBy("key", "id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("bucket"), F.col("id").alias("same"))
        single = materialise(windows.join(twice, (apart("key") == apart("bucket")) & (F.col("id") == F.col("same")), "left_semi").select("row", "first", F.lit(1).cast("long").alias("n")), "single")
        release(parts, windows, open_runs, open_blocks, large)
    own = found.where("key is null").select("row", "first", "n")
    return own.union(whole).union(refined_runs).union(whole_blocks).union(single)


def cut(documents: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes themselves) of every text."""
    schema = T.StructType([*CUT.fields, *([KEPT] if with_bytes else [])])
    spans = covered_windows(documents).groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    rows = _keyed(documents).join(spans, "row", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text, found in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), _texts(batch.column(2)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, at, removed, count = [], 0, 0, 0
                for a, b in _merged((s["first"], s["first"] + s["n"] + DEPTH - 1) for s in found or ()):
                    kept.append(data[at:a])
                    at, removed, count = b, removed + b - a, count + 1
                left = b"".join([*kept, data[at:]])
                for to, x in zip(out, (doc, len(data), removed, count, hashlib.sha256(left).hexdigest(), left), strict=False):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)], schema.names)

    return map_arrow(rows, run, schema)


def _merged(spans) -> Iterator[tuple[int, int]]:
    """Sorted spans with those that touch or overlap joined."""
    now = None
    for a, b in sorted(spans):
        if now and a <= now[1]:
            now = (now[0], max(b, now[1]))
        else:
            if now:
                yield now
            now = (a, b)
    if now:
        yield now


#: All 200-byte windows in one query, for small tables.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT k, unnest(range(1, octet_length(b) - 198)) AS i, b FROM d WHERE octet_length(b) >= 200
), h AS (
  SELECT k, i, sha256(b[i : i + 199]) AS h FROM w
), twice AS (
  SELECT h FROM h GROUP BY 1 HAVING count(*) > 1
), hit AS (
  SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM h SEMI JOIN twice USING (h)
), run AS (
  SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM hit
), span AS (
  SELECT k, run, min(i) AS a, max(i) + 199 AS z FROM run GROUP BY 1, 2
), gap AS (
  SELECT k, run, coalesce(lag(z) OVER (PARTITION BY k ORDER BY run), 0) + 1 AS a, span.a - 1 AS z, span.z - span.a + 1 AS removed, span.z AS last FROM span
), cut AS (
  SELECT d.k, sum(removed) AS removed, count(*) AS spans, list(d.b[gap.a : gap.z] ORDER BY run) AS parts, max(last) AS last FROM gap JOIN d USING (k) GROUP BY 1
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE list_reduce(list_append(parts, b[last + 1 : octet_length(b)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""
