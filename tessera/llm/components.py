"""Connected components by alternating large-star and small-star.

Before the first round each partition replaces its edges by stars of their components (a combiner: its memory is that
of one partition, of about PARTITION_EDGES edges), so the rounds work on what partitions have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, map_arrow, materialise, release

PARTITION_EDGES = 200_000

#: Rounds after which a graph that has not settled counts as an error; each round at least halves the distances.
MOST_ROUNDS = 60


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (node, other): each node's other nodes next to the smallest of them and itself.

    The minimum is combined before the shuffle; the join that brings it back can be split where a hub is hot.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("hub"), F.least("node", "m").alias("m"))
    return pairs.join(least, apart("node") == apart("hub")).select("node", "other", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return _stars(both).where(F.col("other") > F.col("node")).select(F.col("other").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
    stars = _stars(down)
    linked = stars.where(F.col("other") != F.col("m")).select(F.col("other").alias("u"), F.col("m").alias("v"))
    return linked.union(stars.select(F.col("node").alias("u"), F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksums of a written set of edges: three numbers, whatever its size."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first())


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one partition -> (node, smallest node that its edges reach), without the smallest themselves."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(u), find(v)
            if p != q:
                root[max(p, q)] = min(p, q)
    found = [(x, find(x)) for x in root]
    found = [(x, top) for x, top in found if x != top]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["u", "v"])


def components(edges: DataFrame, roots: bool = True) -> DataFrame:
    """edges (u, v: long) -> node, component: the smallest node reachable, for every node that has an edge.

    Self-loops, repeated edges, either direction and nulls are allowed; edges with a null end, and self-loops, link
    nothing. Every round is written to the shared store, so lineage stays short and lost executors cost one round.
    Without roots, the smallest node of each component has no row of its own.
    """
    given = materialise(edges.where("u <> v").select("u", "v"), "edges")
    parts = 1 + given.count() // PARTITION_EDGES
    now = materialise(map_arrow(given.coalesce(parts), local_stars, "u long, v long"), "edges")
    release(given)
    seen = _print(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        after = materialise(small_star(large_star(now)).distinct(), "edges")
        release(now)
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()) if roots else out
