"""Artifacts: upsert fold, pulling partial ones, re-chunking of lists, merging of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from .events import unclaimed


def upserted(writes: DataFrame) -> DataFrame:
    """Writes (task_id, node_id, batch_uid, status, meta, worker_id, seq) folded by key; a null uid is a key of its own.

    worker_id and created_seq are the first write's, status, meta and updated_seq the last one's; writes counts them.
    """
    last = F.max_by(F.struct("status", "meta", "seq"), "seq").alias("_last")
    out = writes.groupBy("task_id", "node_id", "batch_uid").agg(F.min(F.struct("seq", "worker_id")).alias("_first"), last, F.count("*").alias("writes"))
    return out.select("task_id", "node_id", "batch_uid", F.col("_first.worker_id").alias("worker_id"), F.col("_first.seq").alias("created_seq"), F.col("_last.status").alias("status"), F.col("_last.meta").alias("meta"), F.col("_last.seq").alias("updated_seq"), "writes")


def checked_uid(uid: str | None) -> str:
    if not uid:
        raise ValueError("batch_uid must not be empty")
    return uid


def pull(artifacts: DataFrame, from_nodes: list[str], claims: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Partial artifacts of the sources that no consumer row has claimed; all of them, not a page."""
    rows = artifacts.where(F.col("node_id").isin(*from_nodes) & (F.col("status") == "partial"))
    return unclaimed(rows, claims, keys) if claims is not None else rows


def claimed(artifacts: DataFrame, from_nodes: list[str], claims: DataFrame, consumer: str, at: str = "created_at") -> DataFrame:
    """The claims that a poll of the consumer adds: task_id, consumer_node, from_node, batch_uid, each once.

    claims has these columns. Written before the batches are handled, they make every batch be handled at most once by
    a consumer; batches without uid are never claimed.
    """
    mine = claims.where(F.col("consumer_node") == consumer).select("task_id", F.col("from_node").alias("node_id"), "batch_uid")
    rows = pull(artifacts, from_nodes, mine, ["task_id", "node_id", "batch_uid"]).where(F.coalesce(F.col("batch_uid") != "", F.lit(False)))
    return rows.groupBy("task_id", F.lit(consumer).alias("consumer_node"), F.col("node_id").alias("from_node"), "batch_uid").agg(F.min(at).alias(at))


def page(rows: DataFrame, from_nodes: list[str], size: int, at: str = "created_at", tie: str = "batch_uid") -> DataFrame:
    """The oldest rows of each source, up to a page; sources keep the order in which they are named, as source_no."""
    number = F.array_position(F.array(*[F.lit(n) for n in from_nodes]), F.col("node_id").cast("string")) - 1
    w = Window.partitionBy("node_id").orderBy(at, tie)
    ranked = rows.where(F.col("node_id").isin(*from_nodes)).withColumn("source_no", number).withColumn("row_no", F.row_number().over(w))
    return ranked.where(F.col("row_no") <= size)


def idle_delays(polls: DataFrame, keys: list[str], order: str, got: str, poll_ms: int, most_ms: int) -> DataFrame:
    """polls with delay_ms, the wait after each: none after data, else poll_ms doubled for every idle poll since, up to most_ms."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = polls.withColumn("_run", F.sum(F.col(got).cast("long")).over(w))
    nth = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order)) - F.when(F.max(F.col(got)).over(Window.partitionBy(*keys, "_run")), 2).otherwise(1)
    grown = F.least(F.lit(float(most_ms)), F.lit(float(poll_ms)) * F.pow(F.lit(2.0), F.least(F.lit(40), nth)))
    return run.withColumn("delay_ms", F.when(F.col(got), F.lit(0.0)).otherwise(grown).cast("long")).drop("_run")


def ended(artifacts: DataFrame, from_nodes: list[str], claims: DataFrame, consumer: str) -> DataFrame:
    """task_id, ended: whether a consumer may stop: every source is complete and nothing is left to claim."""
    whole = upstream_complete(artifacts, from_nodes)
    left = claimed(artifacts.withColumn("created_at", F.lit(0)), from_nodes, claims, consumer).groupBy("task_id").agg(F.count("*").alias("_left"))
    return whole.join(left, "task_id", "left").select("task_id", (F.col("complete") & (F.coalesce("_left", F.lit(0)) == 0)).alias("ended"))


def upstream_complete(artifacts: DataFrame, from_nodes: list[str]) -> DataFrame:
    """task_id, complete: whether every source has a complete artifact."""
    rows = artifacts.where(F.col("node_id").isin(*from_nodes))
    return rows.groupBy("task_id").agg((F.count_distinct(F.when(F.col("status") == "complete", F.col("node_id"))) == len(set(from_nodes))).alias("complete"))


def chunks(items: Column, size: int) -> Column:
    """Consecutive slices of up to size items; no items, no slices."""
    size = max(1, size)
    n = F.size(items)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))
    return F.when(n > 0, cut)


def rechunk(rows: DataFrame, items: Column | str, size: int, source: Column, parent: Column) -> DataFrame:
    """Every row's list cut into chunks: chunk_no, chunk, chunk_uid; a chunk never crosses rows."""
    items = F.col(items) if isinstance(items, str) else items
    out = rows.withColumn("_src", source).withColumn("_parent", parent).select("*", F.posexplode(chunks(items, size)).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_uid", stable_id("_src", "_parent", F.col("chunk_no").cast("string"))).drop("_src", "_parent")


def source_chunks(items: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Rows numbered and dealt to chunks of size in their order, as a source splits its range: item_no, chunk_no."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return items.withColumn("item_no", n.cast("long")).withColumn("chunk_no", F.floor(F.col("item_no") / max(1, size)).cast("long"))


def single_item(row: Column) -> Column:
    """A row without a list is its own only item."""
    return F.array(row)


def merge_meta(artifacts: DataFrame, from_nodes: list[str]) -> DataFrame:
    """task_id, complete_nodes (sorted, distinct), partial_batches, distinct_batch_uids over the sources' artifacts."""
    rows = artifacts.where(F.col("node_id").isin(*from_nodes))
    partial = F.col("status") == "partial"
    return rows.groupBy("task_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("status") == "complete", F.col("node_id")))).alias("complete_nodes"),
        F.count_if(partial).alias("partial_batches"),
        F.count_distinct(F.when(partial & (F.col("batch_uid") != ""), F.col("batch_uid"))).alias("distinct_batch_uids"),
    )
