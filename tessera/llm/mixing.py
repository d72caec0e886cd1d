"""Mixing sources to target weights (operator 8), by Efraimidis-Spirakis sampling in DataFrame functions.

Every source gets a share of all words by its weight; shares stop at MOST_EPOCHS times the source's size, and what is
above is dealt again by weight until none is above (water filling, in closed form over the sources in the order in
which they reach their limit). A source's target is taken as complete epochs first; for the rest, its documents stand
in the order of their exponential keys, -ln(u) / weight with u from a hash of doc_id, and are taken from the front up
to the budget (the last one if that brings the sum nearer).

The order's prefix sums never gather a source in one task: keys are cut into ranges, sizes are summed by source and
range before they are shuffled, and only the one range of each source in which the budget ends is sorted, equal rows
as one with their number. The result is one threshold a source, so choosing and repeating the documents needs no
shuffle of texts. Where the budget ends among equal rows, so many of them are taken as bring it nearest; as they are
equal, it matters to no one which.

Defined results: null and empty texts have size 0 and are taken in no words; null sources are one source, the last;
a source without words has target 0; a document without doc_id has the key of its text; repeated rows are repeated
documents and may be taken differently often; further columns are ignored by taken() and kept by mix(). The same rows
always give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_or_null, materialise
from .quality_rules import words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Mean number of rows in a range of keys, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 4096, 64
BROADCAST_SOURCES = 20_000
#: Equal rows that one task repeats at a time.
PART_ROWS = 1 << 20
#: Symbols that lower a document's weight, and how much of them halves it; words at which length gives half weight.
SYMBOLS, HALF_SYMBOLS, HALF_WORDS = "[#*$%&|<>]", 0.05, 20.0


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns; columns that have none of their own (maps, variants) are hashed as JSON."""
    plain = lambda t: not any(x in t for x in ("map<", "variant"))
    return F.xxhash64(*[F.col(f"`{c}`") if plain(t) else F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c, t in df.dtypes])


def with_keys(documents: DataFrame) -> DataFrame:
    """documents with mix_source (never null), mix_size, mix_id, mix_key and mix_tie (a hash of the row). No shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = documents.withColumn("mix_tie", _row_hash(documents.select("mix_row") if "mix_row" in documents.columns else documents))
    out = out.withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")))
    out = out.withColumn("mix_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    out = out.withColumn("mix_size", F.size(words_of(text)).cast("long"))
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.lit(1), "mix_size")
    weight = (F.lit(0.1) + F.col("mix_size") / (F.col("mix_size") + HALF_WORDS)) / (F.lit(1.0) + symbols / HALF_SYMBOLS)
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("n"), text))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return out.withColumn("mix_key", -F.log(u) / weight)


def targets(sizes: DataFrame) -> DataFrame:
    """mix_source, source_size, n_rows, target, epochs, rest. The windows run over one row for each source."""
    by_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_rows"))
    nth = F.row_number().over(Window.orderBy("mix_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (nth % len(WEIGHTS) + 1).cast("int"))
    weighted = by_source.withColumn("w", weight.cast("double")).withColumn("limit", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    weighted = weighted.withColumn("reach", F.col("limit") / F.col("w"))
    before = Window.orderBy("reach", "mix_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    none = F.lit(0.0)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(before), none)) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), none))
    leveled = weighted.withColumn("level", level).withColumn("full", F.col("level") > F.col("reach"))
    shared = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct("reach", "mix_source"))).over(every)
    out = leveled.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("w") * F.coalesce(shared, none))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.lit(1), "source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs)
    return out.select("mix_source", "source_size", "n_rows", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _range(ranges: int) -> Column:
    """Number of a key's range; keys have no upper bound, so they are bent into (0, 1) first."""
    return F.floor(F.col("mix_key") / (F.col("mix_key") + 1.0) * ranges).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose rows were counted; beyond the bound let it be joined by key."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


#: The order of a source's rows; rows alike in all of it are equal.
ORDER = ("mix_key", "mix_id", "mix_size", "mix_tie")


def plan(documents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sized rows, one row for each source with its target and threshold, and the number of ranges of keys.

    The threshold: rows of ranges before last_range, and those of it up to `through`, are taken once more; of the
    rows equal to `split` (at most one kind a source), some_taken of some_all.
    """
    sizes = materialise(with_keys(documents).select("doc_id", "mix_source", *ORDER), "sizes")
    found = materialise(targets(sizes), "targets")
    totals = found.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")).first()
    ranges = LEAST_RANGES
    while ranges * RANGE_ROWS < totals[0]:
        ranges *= 2
    summed = sizes.groupBy("mix_source", _range(ranges).alias("at")).agg(F.sum("mix_size").alias("s"))
    so_far = summed.withColumn("before", F.sum("s").over(Window.partitionBy("mix_source").orderBy("at")) - F.col("s"))
    rest = _small(found.select("mix_source", "rest"), totals[1])
    last = so_far.join(rest, "mix_source").where("before <= rest and rest < before + s").select("mix_source", F.col("at").alias("last_range"), "before", "rest")
    last = materialise(last, "boundary")
    bounds = _small(last, totals[1])
    inside = sizes.join(bounds, "mix_source").where(_range(ranges) == F.col("last_range"))
    kinds = inside.groupBy("mix_source", *ORDER).agg(F.count("*").alias("n")).join(bounds, "mix_source")
    size, words = F.col("mix_size"), F.col("mix_size") * F.col("n")
    order = Window.partitionBy("mix_source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = kinds.withColumn("ahead", F.col("before") + F.sum(words).over(order) - words)
    fits = lambda c: F.col("ahead") + c * size + size / 2 <= F.col("rest")  # noqa: E731  # whether the row after c equal ones is taken
    about = F.floor((F.col("rest") - F.col("ahead") - size / 2) / F.greatest(F.lit(1), size)).cast("long")
    exact = F.when(fits(about + 1), about + 2).when(fits(about), about + 1).otherwise(about)
    kinds = kinds.withColumn("m", F.when(size == 0, F.when(fits(F.lit(0)), F.col("n")).otherwise(F.lit(0))).otherwise(F.greatest(F.lit(0), F.least("n", exact))).cast("long"))
    part = (F.col("m") > 0) & (F.col("m") < F.col("n"))
    ends = kinds.groupBy("mix_source").agg(
        F.max(F.when(F.col("m") == F.col("n"), F.struct(*ORDER))).alias("through"),
        F.max(F.when(part, F.struct(F.struct(*ORDER).alias("kind"), "m", "n"))).alias("some"),
    )
    ends = ends.select("mix_source", "through", F.col("some.kind").alias("split"), F.col("some.m").alias("some_taken"), F.col("some.n").alias("some_all"))
    out = found.join(_small(last.select("mix_source", "last_range"), totals[1]), "mix_source", "left").join(_small(ends, totals[1]), "mix_source", "left")
    return sizes, materialise(out, "mix"), ranges


def _copies(rows: DataFrame, sources: DataFrame, ranges: int) -> DataFrame:
    """rows with keys, next to how often each is taken (null for those of a kind that is taken in part)."""
    at = _range(ranges)
    kind = F.struct(*ORDER)
    picked = (at < F.col("last_range")) | ((at == F.col("last_range")) & (kind <= F.col("through")))
    joined = rows.join(_small(sources, sources.count()), "mix_source")
    every = F.least(F.lit(MOST_EPOCHS), F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("long"))
    return joined.withColumn("copies", F.when(~F.coalesce(kind == F.col("split"), F.lit(False)), every))


def _repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, in two steps, so that a large number is dealt over tasks and never one array."""
    parts = rows.withColumn("mix_times", times).withColumn("mix_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_times") - 1) / PART_ROWS)))).where("mix_times > 0")
    spread = parts.repartition("mix_source", "mix_part")
    left = F.least(F.lit(PART_ROWS).cast("long"), F.col("mix_times") - F.col("mix_part") * PART_ROWS)
    return spread.withColumn("mix_part", F.explode(F.array_repeat(F.lit(1), left.cast("int")))).drop("mix_times", "mix_part")


def taken(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted)."""
    sizes, sources, ranges = plan(columns_or_null(documents, {"doc_id": "long", "text": "string", "source": "string"}))
    result = lambda copies: ["doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * copies).alias("taken")]
    whole = _copies(sizes, sources, ranges).where("copies is not null").select(*result(F.col("copies")))
    some = sources.where("split is not null").select("mix_source", "source_size", "target", "epochs", "some_taken", "some_all", "split.*")
    some = some.withColumn("doc_id", F.when(F.col("mix_id") != -(2**63), F.col("mix_id")))
    more = _repeated(some, F.col("some_taken")).select(*result(F.col("epochs") + 1))
    less = _repeated(some, F.col("some_all") - F.col("some_taken")).select(*result(F.col("epochs")))
    return whole.union(more).union(less)


def mix(documents: DataFrame) -> DataFrame:
    """The mixed corpus: documents, each as often as it is taken. All columns stay; texts are not shuffled."""
    have = set(documents.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("mix_row")  # columns of any name stay out of the way
    given = documents.select(whole, *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string"))])
    _, sources, ranges = plan(given)
    needed = ["mix_source", "epochs", "last_range", "through", "split", "some_taken", "some_all"]
    rows = _copies(with_keys(given), sources.select(*needed), ranges)
    out = rows.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(0)).cast("int")))).select("mix_row.*")
    if not sources.where("split is not null").limit(1).count():
        return out
    # rows of a kind that is taken in part are equal: one of them stands for all that are taken
    one = rows.where("copies is null").groupBy("mix_source").agg(F.first("mix_row").alias("mix_row"), F.first("epochs").alias("e"), F.first("some_taken").alias("m"), F.first("some_all").alias("n"))
    return out.union(_repeated(one, F.col("e") * F.col("n") + F.col("m")).select("mix_row.*"))


#: The same selection in one query for an engine without a cluster: the whole of every source is sorted.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, coalesce(doc_id, -9223372036854775808) AS id, md5(coalesce(CAST(doc_id AS VARCHAR), 'n' || coalesce(text, ''))) AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS DOUBLE) AS symbols
  FROM documents
), k AS (
  SELECT doc_id, src, id, size,
         -ln((CAST(CAST('0x' || substr(name, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / ((0.1 + CAST(size AS DOUBLE) / (CAST(size AS DOUBLE) + 20.0)) / (1.0 + symbols / CAST(greatest(1, size) AS DOUBLE) / 0.05)) AS key
  FROM d
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM k GROUP BY src
), r AS (
  SELECT src, source_size, w, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / w AS reach FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM r WINDOW b AS (ORDER BY reach, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS shared FROM l WHERE NOT level > reach ORDER BY reach, src LIMIT 1
), t AS (
  SELECT src, source_size, CASE WHEN level > reach THEN cap ELSE least(cap, w * coalesce((SELECT shared FROM f), 0.0)) END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / greatest(1, source_size)) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT doc_id, size, source_size, target, epochs, target - CAST(epochs * source_size AS DOUBLE) AS rest,
         CAST(sum(size) OVER (PARTITION BY src ORDER BY key, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS ahead
  FROM k JOIN e USING (src)
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, epochs + CASE WHEN ahead + size / 2.0 <= rest AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
