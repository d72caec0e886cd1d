"""Outbox retries, liveness, discovery windows and request/reply matching as plain expressions over a literal now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, elapsed_ms, stable_id
from .events import first_wins


def fingerprint(topic: Column | str, key: Column | str, dedup_id: Column | str) -> Column:
    return stable_id(topic, key, dedup_id)


def enqueued(rows: DataFrame, order: list[str]) -> DataFrame:
    """Outbox rows, one for each fingerprint: a repeated enqueue is ignored."""
    return first_wins(rows.withColumn("fp", fingerprint("topic", "key", "dedup_id")), ["fp"], order)


def due(outbox: DataFrame, now_ms: Column | int, limit: int, order: list[str]) -> DataFrame:
    """The earliest rows that are due, up to a page: a top-k without a full sort."""
    rows = outbox.where(F.col("state").isin("pending", "retry") & (F.col("next_attempt_at_ms") <= now_ms))
    return rows.orderBy(*order).limit(limit)


def after_attempt(outbox: DataFrame, sent: Column, now_ms: int, max_attempts: int = 12, least_ms: int = 250, most_ms: int = 60_000) -> DataFrame:
    """State after a delivery attempt: sent, or one more attempt, which is the last or is retried after a backoff."""
    tries = F.when(sent, F.col("attempts")).otherwise(F.col("attempts") + 1)
    state = F.when(sent, "sent").when(tries >= max_attempts, "failed").otherwise("retry")
    at = F.when(state == "retry", now_ms + backoff_ms(tries, least_ms, most_ms))
    return outbox.withColumn("new_attempts", tries).withColumn("new_state", state).withColumn("new_next_attempt_at_ms", at)


def liveness(last_event_ms: Column, now_ms: int, soft_sec: int = 300, hard_sec: int = 3600) -> Column:
    """dead from the hard limit of idle time on, suspected from the soft one on, else alive."""
    idle = elapsed_ms(now_ms, last_event_ms)
    return F.when(idle >= hard_sec * 1000, "dead").when(idle >= soft_sec * 1000, "suspected").otherwise("alive")


def may_start(last_event_ms: Column, status: Column, now_ms: int, window_sec: int = 8) -> Column:
    """Not while its last event lies within the discovery window, unless the node is deferred."""
    return (status == "deferred") | last_event_ms.isNull() | (elapsed_ms(now_ms, last_event_ms) >= window_sec * 1000)


def replies_in_window(requests: DataFrame, replies: DataFrame, window_ms: int) -> DataFrame:
    """Replies matched to requests by corr_id within a time window; as streams with watermarks it is an interval join.

    Time is cut into pieces of the window's length and a request asks in two of them, so a corr_id with a long history
    meets only what is near, in as many tasks as it has pieces.
    """
    piece = lambda c: F.floor(F.col(c) / max(1, window_ms)).cast("long")
    q = requests.withColumnRenamed("ts_ms", "asked_ms").withColumn("_piece", F.explode(F.array_distinct(F.array(piece("asked_ms"), piece("asked_ms") + 1))))
    r = replies.withColumn("_piece", piece("ts_ms"))
    return q.join(r, ["corr_id", "_piece"]).where((F.col("ts_ms") >= F.col("asked_ms")) & (F.col("ts_ms") <= F.col("asked_ms") + window_ms)).drop("_piece")


def monitored(tasks: DataFrame, now_ms: int, soft_sec: int = 300, hard_sec: int = 3600) -> DataFrame:
    """Running and deferred tasks with the state that a heartbeat monitor gives them: dead ones fail, suspected ones retry in a minute."""
    state = liveness(F.coalesce("last_event_recv_ms", F.lit(0)), now_ms, soft_sec, hard_sec)
    watched = F.col("status").isin("running", "deferred")
    rows = tasks.withColumn("liveness", F.when(watched, state))
    status = F.when(F.col("liveness") == "dead", "failed").when(F.col("liveness") == "suspected", "deferred").otherwise(F.col("status"))
    return rows.withColumn("new_status", status).withColumn("new_retry_ms", F.when(F.col("liveness") == "suspected", F.lit(now_ms + 60_000).cast("long")))


def heartbeats(runs: DataFrame, interval_ms: int, lease_ttl_ms: int) -> DataFrame:
    """The heartbeats of runs (worker_id, task_id, node_id, attempt_epoch, started_ms, ended_ms): one each interval.

    ts_ms, lease_deadline_ms, and a dedup_id that is the same for all heartbeats of a run within one interval.
    """
    at = F.explode(F.sequence("started_ms", F.col("ended_ms") - 1, F.lit(interval_ms).cast("long")))
    rows = runs.where(F.col("ended_ms") > F.col("started_ms")).withColumn("ts_ms", at)
    bucket = F.floor(F.col("ts_ms") / max(1, interval_ms)).cast("long")
    return rows.withColumn("lease_deadline_ms", F.col("ts_ms") + lease_ttl_ms).withColumn("dedup_id", stable_id(F.lit("hb"), "task_id", "node_id", "attempt_epoch", bucket))


def accepted_starts(commands: DataFrame, run_ms: str) -> DataFrame:
    """Start commands that a worker with room for one run takes; those that come while it is busy are dropped.

    commands: worker_id, ts_ms, seq and the length of the run. Which one is taken depends on all before, so a worker's
    commands are passed in order, by a task that remembers the end of one run.
    """
    rows = commands.repartition("worker_id").sortWithinPartitions("worker_id", "ts_ms", "seq")

    def run(frames):
        worker, free = None, 0
        for pdf in frames:
            taken = []
            for w, at, length in zip(pdf["worker_id"], pdf["ts_ms"], pdf[run_ms], strict=True):
                if w != worker:
                    worker, free = w, at
                taken.append(at >= free)
                if taken[-1]:
                    free = at + length
            yield pdf[taken]

    return rows.mapInPandas(run, rows.schema)
