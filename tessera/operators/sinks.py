"""Rows that accepted events leave behind: metrics, artifacts, statistics, registries; and the outbox's delivery.

Events have the columns task_id, node_id, kind, batch_uid, metrics map<string,string>, artifacts_ref, reason, epoch,
ts_ms and seq (a total order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reliability import after_attempt

FINAL_UID = "__final__"
METRICS = ["task_id", "node_id", "batch_uid", "metrics", "failed", "final", "reason", "attempt_epoch", "ts_ms", "seq"]


def metric_writes(events: DataFrame) -> DataFrame:
    """A metrics row for each batch that has metrics, for each failed batch (without any), and for each end that has some."""
    kind, some = F.col("kind"), F.coalesce(F.size("metrics") > 0, F.lit(False))
    bad, end = kind == "BATCH_FAILED", kind == "TASK_DONE"
    rows = events.where(bad | (some & kind.isin("BATCH_OK", "TASK_DONE")))
    uid = F.when(end, F.coalesce("batch_uid", F.lit(FINAL_UID))).otherwise(F.col("batch_uid"))
    none = F.create_map().cast("map<string,string>")
    values = {"batch_uid": uid, "metrics": F.when(bad, none).otherwise(F.col("metrics")), "failed": bad, "final": end, "reason": F.when(bad, F.col("reason")), "attempt_epoch": F.col("epoch")}
    return rows.withColumns(values).select(*METRICS)


def artifact_writes(events: DataFrame) -> DataFrame:
    """Writes for artifacts.upserted(): partial for a batch with a reference, failed, and complete (without uid) at the end."""
    kind, ref = F.col("kind"), F.col("artifacts_ref").isNotNull()
    rows = events.where((kind == "BATCH_FAILED") | (ref & kind.isin("BATCH_OK", "TASK_DONE")))
    status = F.when(kind == "BATCH_OK", "partial").when(kind == "BATCH_FAILED", "failed").otherwise("complete")
    uid = F.when(kind != "TASK_DONE", F.col("batch_uid"))
    return rows.select("task_id", "node_id", uid.alias("batch_uid"), status.alias("status"), F.col("metrics").alias("meta"), F.lit(None).cast("string").alias("worker_id"), "seq", F.col("reason").alias("error"))


def complete_ref(ref: Column, task: Column, node: Column) -> Column:
    """The reference that marking complete returns: the given one, or task and node."""
    return F.coalesce(ref, F.to_json(F.struct(task.alias("task_id"), node.alias("node_id"))))


def with_stats(nodes: DataFrame, stats: DataFrame, now_ms: int) -> DataFrame:
    """nodes with stats (task_id, node_id, stats) written to them, and when; others keep what they have."""
    rows = nodes.join(stats.withColumnRenamed("stats", "_new"), ["task_id", "node_id"], "left")
    hit = F.col("_new").isNotNull()
    return rows.withColumns({"stats": F.coalesce("_new", "stats"), "stats_cached_at": F.when(hit, F.lit(now_ms)).otherwise(F.col("stats_cached_at"))}).drop("_new")


def worker_registry(announced: DataFrame) -> DataFrame:
    """worker_id, type, status, last_seen from announcements (worker_id, kind, type, at): one aggregate, no sort.

    WORKER_ONLINE sets all, WORKER_OFFLINE the status of a worker that is known by then, any other kind last_seen.
    """
    online, offline = F.col("kind") == "WORKER_ONLINE", F.col("kind") == "WORKER_OFFLINE"
    rows = announced.groupBy("worker_id").agg(
        F.min(F.when(~offline, F.col("at"))).alias("_first"),
        F.max("at").alias("last_seen"),
        F.max(F.when(online | offline, F.struct("at", "kind"))).alias("_last"),
        F.max(F.when(online, F.struct("at", "type"))).alias("_type"),
    )
    status = F.when(F.col("_last.kind") == "WORKER_ONLINE", "online").when(F.col("_last.at") > F.col("_first"), "offline")
    return rows.where("_first is not null").select("worker_id", F.col("_type.type").alias("type"), status.alias("status"), "last_seen")


def active_runs(writes: DataFrame) -> DataFrame:
    """The last state written by each worker (worker_id, run, at); a null run means that it is idle."""
    last = writes.groupBy("worker_id").agg(F.max(F.struct("at", "run")).alias("_last"))
    return last.select("worker_id", F.col("_last.run").alias("run"), F.col("_last.at").alias("updated_at"))


def resumable(states: DataFrame) -> DataFrame:
    """Runs that a worker takes up again when it starts."""
    return states.where(F.col("run").isNotNull())


def dispatch(due: DataFrame, send: Callable[[str, str, str], None], now_ms: int) -> DataFrame:
    """Deliver outbox rows (fp, topic, key, envelope, attempts) at least once; fp, and their state after the attempt.

    send raises where it fails. Rows are delivered by the tasks, so a task that runs again sends again: receivers
    drop repeats by dedup_id, as they must with any such outbox.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sent, errors = [], []
            for t, k, e in zip(pdf["topic"], pdf["key"], pdf["envelope"], strict=True):
                try:
                    send(t, k, e)
                    sent.append(True)
                    errors.append(None)
                except Exception as error:  # delivery code
                    sent.append(False)
                    errors.append(str(error))
            yield pd.DataFrame({"fp": pdf["fp"], "attempts": pdf["attempts"], "ok": sent, "last_error": errors})

    tried = due.select("fp", "topic", "key", "envelope", F.col("attempts").cast("int")).mapInPandas(run, "fp string, attempts int, ok boolean, last_error string")
    out = after_attempt(tried, F.col("ok"), now_ms)
    return out.select("fp", F.col("new_state").alias("state"), F.col("new_attempts").alias("attempts"), F.col("new_next_attempt_at_ms").alias("next_attempt_at_ms"), "last_error")
