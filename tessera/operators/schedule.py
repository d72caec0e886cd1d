"""Scheduling of task graphs as table operators: readiness, preflight, starts, functions of the coordinator, cancelling.

A tick takes the tables as they are and returns the changes; the clock is an argument, so a tick over the same tables
gives the same result. nodes have the columns of graph.NODES.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id, topic
from .graph import OPEN, adoptable, ready
from .reliability import may_start

NODE = ["task_id", "node_id"]
FUNCTION_TYPE = "coordinator_fn"


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that a tick looks at: running, queued or deferred, and not cancelled."""
    return tasks.where(F.col("status").isin(*OPEN) & ~F.coalesce(F.col("cancelled"), F.lit(False)))


def started_tasks(tasks: DataFrame) -> DataFrame:
    """tasks with queued ones of open_tasks() running."""
    go = (F.col("status") == "queued") & ~F.coalesce(F.col("cancelled"), F.lit(False))
    return tasks.withColumn("status", F.when(go, "running").otherwise(F.col("status")))


def preflight(due: DataFrame, artifacts: DataFrame, snapshots: DataFrame, now_ms: int, window_sec: int = 8) -> DataFrame:
    """Nodes that are due, with a decision: complete, adopt, complete_snapshot, gated or start; the first that applies.

    complete: a complete artifact is there, so the node need not run. adopt: a worker that held the lease still runs
    this epoch. complete_snapshot: a worker reports complete artifacts. gated: the last event is too fresh.
    """
    done = artifacts.where(F.col("status") == "complete").select(*NODE).distinct().withColumn("_done", F.lit(True))
    held = adoptable(due, snapshots).select(*NODE).withColumn("_held", F.lit(True))
    told = snapshots.where(F.coalesce(F.col("complete"), F.lit(False))).select(*NODE).distinct().withColumn("_told", F.lit(True))
    rows = due.join(done, NODE, "left").join(held, NODE, "left").join(told, NODE, "left")
    decision = F.when(F.col("_done"), "complete").when(F.col("_held"), "adopt").when(F.col("_told"), "complete_snapshot").when(~may_start(F.coalesce(F.col("last_event_ms"), F.lit(0)), F.col("status"), now_ms, window_sec), "gated").otherwise("start")
    return rows.withColumn("decision", decision).drop("_done", "_held", "_told")


def decided(rows: DataFrame) -> DataFrame:
    """new_status and new_epoch by decision. Adopted nodes run on in their epoch, gated ones stay as they are."""
    d = F.col("decision")
    status = F.when(d.isin("complete", "complete_snapshot"), "finished").when(d.isin("adopt", "start"), "running").otherwise(F.col("status"))
    return rows.withColumn("new_status", status).withColumn("new_epoch", F.col("attempt_epoch") + d.isin("complete", "complete_snapshot", "start").cast("int"))


def run_functions(rows: DataFrame, known: Collection[str], now_ms: int, default_backoff_sec: int = 300) -> DataFrame:
    """Function nodes that are due: finished in the next epoch, or deferred with a retry where the function is unknown.

    A function that raises is deferred alike by its caller; a node without one does nothing (noop).
    """
    ok = F.coalesce(F.col("fn"), F.lit("noop")).isin(*known)
    retry = now_ms + F.coalesce("backoff_sec", F.lit(default_backoff_sec)).cast("long") * 1000
    return rows.withColumns({"decision": F.lit("function"), "new_status": F.when(ok, "finished").otherwise("deferred"), "new_epoch": F.col("attempt_epoch") + 1, "new_retry_ms": F.when(~ok, retry)})


def tick(tasks: DataFrame, nodes: DataFrame, artifacts: DataFrame, snapshots: DataFrame, known: Collection[str], now_ms: int, window_sec: int = 8) -> DataFrame:
    """One row for each node that is due in an open task: task_id, node_id, decision, new_status, new_epoch, new_retry_ms."""
    due = nodes.join(ready(nodes, artifacts, now_ms), NODE, "left_semi").join(open_tasks(tasks).select("task_id"), "task_id", "left_semi")
    kind = F.coalesce("type", F.lit("")) == FUNCTION_TYPE
    out = ["task_id", "node_id", "decision", "new_status", "new_epoch", "new_retry_ms"]
    functions = run_functions(due.where(kind), known, now_ms)
    workers = decided(preflight(due.where(~kind), artifacts, snapshots, now_ms, window_sec)).withColumn("new_retry_ms", F.lit(None).cast("long"))
    return functions.select(*out).union(workers.select(*out))


def applied(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the changes of a tick, compare-and-set: a change counts if the node is still queued or deferred."""
    c = changes.select(*NODE, "new_status", "new_epoch", "new_retry_ms")
    rows = nodes.join(c, NODE, "left")
    hit = F.col("new_status").isNotNull() & F.col("status").isin("queued", "deferred")
    after = {"status": F.when(hit, F.col("new_status")).otherwise(F.col("status")), "attempt_epoch": F.when(hit, F.col("new_epoch")).otherwise(F.col("attempt_epoch")).cast("int"), "next_retry_ms": F.when(hit & F.col("new_retry_ms").isNotNull(), F.col("new_retry_ms")).otherwise(F.col("next_retry_ms"))}
    return rows.withColumns(after).drop("new_status", "new_epoch", "new_retry_ms")


def start_commands(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outbox rows (topic, key, dedup_id, attempt_epoch) that tell workers to start; one dedup_id for each epoch."""
    rows = changes.where(F.col("decision") == "start").join(nodes.select(*NODE, "type"), NODE)
    return rows.select(*NODE, topic("cmd", "type").alias("topic"), F.concat_ws(":", *NODE).alias("key"), stable_id(F.lit("TASK_START"), "task_id", "node_id", "new_epoch").alias("dedup_id"), F.col("new_epoch").alias("attempt_epoch"))


def on_first_batch(batches: DataFrame, tasks: DataFrame, nodes: DataFrame, edges: DataFrame, artifacts: DataFrame, now_ms: int) -> DataFrame:
    """Children that a batch of one of their parents starts: task_id, node_id, go. Each child is a row once.

    A child is asked if its edge is asynchronous and fires on a batch, or if it starts on the first batch, while it is
    queued or deferred and was not asked before. Asynchronous edges start it at once, else it must be ready.
    """
    live = batches.select("task_id", F.col("node_id").alias("src")).distinct().join(tasks.where(~F.coalesce(F.col("cancelled"), F.lit(False))).select("task_id"), "task_id", "left_semi")
    asynchronous = F.coalesce((F.col("mode") == "async") & (F.col("trigger") == "on_batch"), F.lit(False))
    asked = edges.join(live, ["task_id", "src"], "left_semi").groupBy("task_id", F.col("dst").alias("node_id")).agg(F.bool_or(asynchronous).alias("rule_async"))
    free = nodes.where(F.col("status").isin("queued", "deferred") & ~F.coalesce(F.col("started_on_first_batch"), F.lit(False)))
    wants = F.coalesce(F.lower("start_when") == "first_batch", F.lit(False))
    chosen = free.join(asked, NODE).where(F.col("rule_async") | wants).select(*NODE, "rule_async")
    able = ready(nodes.withColumn("next_retry_ms", F.lit(0).cast("long")), artifacts, now_ms).withColumn("_able", F.lit(True))
    return chosen.join(able, NODE, "left").select(*NODE, (F.col("rule_async") | F.coalesce("_able", F.lit(False))).alias("go"))


def flagged(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """nodes with the once-flag set and the retry time cleared where on_first_batch() asked."""
    rows = nodes.join(asked.select(*NODE).withColumn("_hit", F.lit(True)), NODE, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return rows.withColumns({"started_on_first_batch": hit | F.coalesce("started_on_first_batch", F.lit(False)), "next_retry_ms": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("next_retry_ms"))}).drop("_hit")


def created(tasks: DataFrame, now_ms: int) -> DataFrame:
    """New task rows from (task_id, params): queued, with their first entry of history and the time of their last event."""
    entry = F.struct(F.lit(None).cast("string").alias("from"), F.lit("queued").alias("to"), F.lit(now_ms).alias("at_ms"))
    return tasks.select("task_id", F.col("task_id").alias("pipeline_id"), "params", F.lit("queued").alias("status"), F.array(entry).alias("history"), F.lit(now_ms).alias("last_event_recv_ms"), F.lit(False).alias("cancelled"))


def cancel_tasks(tasks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tasks with cancelled and cancel_reason set, and the answer to each request (task_id, reason): false if unknown."""
    wanted = requests.groupBy("task_id").agg(F.min("reason").alias("cancel_reason"))
    known = tasks.join(wanted, "task_id", "left").withColumn("cancelled", F.coalesce(F.col("cancelled"), F.lit(False)) | F.col("cancel_reason").isNotNull())
    answers = wanted.join(tasks.select("task_id").distinct().withColumn("_known", F.lit(True)), "task_id", "left").select("task_id", F.coalesce("_known", F.lit(False)).alias("accepted"))
    return known, answers


def cancel_signals(nodes: DataFrame, grace_ms: int, now_ms: int) -> DataFrame:
    """A signal to the worker that holds the lease of each open node: the task's nodes as they were before cancelling."""
    rows = nodes.where(F.col("status").isin(*OPEN) & F.col("lease_worker").isNotNull())
    return rows.select(*NODE, F.col("lease_worker").alias("target_worker_id"), stable_id(F.lit("CANCEL"), "task_id", "node_id", "attempt_epoch", "lease_worker").alias("dedup_id"), F.lit(now_ms + grace_ms).cast("long").alias("deadline_ms"))


def update_first(nodes: Column, match, **values) -> Column:
    """An array of structs with fields set in its first element that meets match, as a positional update does."""
    at = F.array_position(F.transform(nodes, lambda n: F.coalesce(match(n), F.lit(False))), F.lit(True))
    return F.transform(nodes, lambda n, i: F.when(i + 1 == at, _with_fields(n, values)).otherwise(n))


def _with_fields(struct: Column, values: dict) -> Column:
    for name, value in values.items():
        struct = struct.withField(name, value)
    return struct
