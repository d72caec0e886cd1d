"""Event log to state: first-wins deduplication, fencing by epoch, gated fold, high-water marks, retention."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a total order. The rows themselves are combined before the shuffle.

    A window would send a hot key's rows to one task; here each map task keeps one candidate for each key. Where order
    names columns, they travel once, in front of the others in one struct, whose minimum is the row; columns without
    an order (maps) need a second struct.
    """
    given = dict(df.dtypes)
    named = [c for c in order if isinstance(c, str) and c in given and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in named]
    if len(named) == len(order) and not any(x in given[c] for c in rest for x in ("map<", "variant")):
        first = F.min(F.struct(*named, *rest)).alias("_row")
    else:
        first = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The latest values of each key, as one struct so that they come from one row."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [order, *values]])


def fence(events: DataFrame, nodes: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """Events whose node exists and has their epoch. nodes has one row a key; Spark picks the join by its size."""
    return events.join(nodes.select(*keys, epoch).distinct(), [*keys, epoch], "left_semi")


def not_value(column: Column | str, value) -> Column:
    """Differs from the value, or is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return ~c.eqNullSafe(F.lit(value))


def unclaimed(batches: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    return batches.join(claims, keys, "left_anti")


def within_ttl_dedup(df: DataFrame, keys: list[str], at_ms: str, ttl_ms: int, tie: str) -> DataFrame:
    """Drop a repeat that comes within ttl_ms of the row that was last let through; hits do not extend it.

    The row let through last depends on all rows before, so each key is scanned in order: keys, times and ties alone
    travel, sorted, and a task remembers one key and one time, however long a key's history is. There is no bound on
    the number of keys that are remembered, as there would be in a cache.
    """
    narrow = df.select(*keys, at_ms, tie)
    ordered = narrow.repartition(*keys).sortWithinPartitions(*keys, at_ms, tie)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        now, last = None, 0
        for pdf in frames:
            passes = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                key, at = row[:-2], row[-2]
                if key != now or at - last > ttl_ms:
                    now, last = key, at
                    passes.append(True)
                else:
                    passes.append(False)
            yield pdf[passes]

    kept = ordered.mapInPandas(run, narrow.schema).select(*keys, tie)
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*keys, tie]]
    return df.alias("l").join(kept.alias("r"), same, "left_semi")


def high_water(events: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """Largest value ever seen of each column: monotone whatever the order of arrival."""
    return events.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def retained(df: DataFrame, at_ms: Column, now_ms: int, days: int) -> DataFrame:
    """Rows younger than so many days, as a range predicate that reaches the scan."""
    return df.where(at_ms > now_ms - days * 86_400_000)


#: States from which a node may be cancelled.
OPEN = ("queued", "running", "deferred")
#: Events that need a running node; the others are applied in any state.
GATED = frozenset({"TASK_ACCEPTED", "TASK_HEARTBEAT", "BATCH_OK", "BATCH_FAILED", "TASK_DONE"})

FOLDED = "task_id string, node_id string, status string, epoch int, worker_id string, lease_deadline_ms long, last_event_ms long, batches_ok long, batches_failed long, next_retry_ms long, task_failed boolean, failed_ms long, failed_seq long"


def fold_state(events: DataFrame, backoff_sec: int = 300) -> DataFrame:
    """Exact fold of each node's events in arrival order (recv_ts_ms, seq).

    Columns: task_id, node_id, kind, epoch, recv_ts_ms, seq, worker_id, deadline_ms, batch_uid, permanent. A
    TASK_START sets a running node of its epoch; TASK_CANCEL, which the coordinator itself writes, makes an open node
    cancelling in any epoch; events of another epoch are fenced off; GATED kinds need a running node, so a batch after
    the end is dropped. failed_ms and failed_seq place the first permanent failure. Whether an event counts depends on the state at its arrival, which a
    column expression can't hold, so events are dealt by node, sorted, and passed once: a task remembers one node's
    state and the ids of its batches, never its history.
    """
    given = ["task_id", "node_id", "kind", "epoch", "recv_ts_ms", "seq", "worker_id", "deadline_ms", "batch_uid", "permanent"]
    ordered = events.select(*given).repartition("task_id", "node_id").sortWithinPartitions("task_id", "node_id", "recv_ts_ms", "seq")
    names = [c.split()[0] for c in FOLDED.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        now: _Node | None = None
        for pdf in frames:
            out = []
            for e in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if now is None or now.key != (e.task_id, e.node_id):
                    if now:
                        out.append(now.row())
                    now = _Node((e.task_id, e.node_id), backoff_sec * 1000)
                now.take(e)
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([now.row()], columns=names)

    return ordered.mapInPandas(run, FOLDED)


class _Node:
    """The state of one node while its events pass."""

    def __init__(self, key: tuple, backoff_ms: int):
        self.key, self.backoff_ms = key, backoff_ms
        self.status, self.epoch, self.worker = "queued", 0, None
        self.deadline, self.last, self.retry, self.failed = None, None, None, None
        self.ok: set = set()
        self.bad: set = set()

    def cancel(self) -> None:
        if self.status in OPEN:
            self.status = "cancelling"

    def take(self, e) -> None:
        if e.kind == "TASK_START":
            if self.status in ("queued", "deferred") and e.epoch == self.epoch + 1:
                self.status, self.epoch, self.retry = "running", e.epoch, None
        elif e.kind == "TASK_CANCEL":
            self.cancel()
        elif e.epoch == self.epoch and (e.kind not in GATED or self.status == "running"):
            self.last = e.recv_ts_ms if self.last is None else max(self.last, e.recv_ts_ms)
            self.accepted(e)

    def accepted(self, e) -> None:
        if e.kind in ("TASK_ACCEPTED", "TASK_HEARTBEAT", "TASK_RESUMED"):
            self.worker = e.worker_id
            if e.deadline_ms is not None:
                self.deadline = e.deadline_ms if self.deadline is None or e.kind == "TASK_ACCEPTED" else max(self.deadline, e.deadline_ms)
        elif e.kind in ("BATCH_OK", "BATCH_FAILED"):
            if e.batch_uid not in self.ok and e.batch_uid not in self.bad:
                (self.ok if e.kind == "BATCH_OK" else self.bad).add(e.batch_uid)
        elif e.kind == "TASK_DONE":
            self.status = "finished"
        elif e.kind == "TASK_FAILED" and e.permanent:
            self.failed = self.failed or (e.recv_ts_ms, e.seq)
            self.cancel()
        elif e.kind == "TASK_FAILED":
            self.status, self.retry = "deferred", e.recv_ts_ms + self.backoff_ms
        elif e.kind == "CANCELLED":
            self.status = "deferred"

    def row(self) -> tuple:
        return (*self.key, self.status, self.epoch, self.worker, self.deadline, self.last, len(self.ok), len(self.bad), self.retry, self.failed is not None, *(self.failed or (None, None)))


def with_cascade(events: DataFrame, backoff_sec: int = 300) -> DataFrame:
    """events and, for every node of a task, a TASK_CANCEL where the task's first permanent failure takes effect.

    Whether a failure is the first is known from the nodes' own folds: what cancels other nodes can only be an earlier
    one. So two folds by node are exact, and no task's nodes have to meet.
    """
    alone = fold_state(events, backoff_sec).where("task_failed")
    stop = alone.groupBy("task_id").agg(F.min(F.struct("failed_ms", "failed_seq")).alias("_s"))
    nodes = events.select("task_id", "node_id").distinct().join(stop, "task_id")
    none = lambda c: F.lit(None).cast(dict(events.dtypes)[c]).alias(c)
    given = {"task_id": F.col("task_id"), "node_id": F.col("node_id"), "kind": F.lit("TASK_CANCEL"), "recv_ts_ms": F.col("_s.failed_ms"), "seq": F.col("_s.failed_seq")}
    return events.union(nodes.select(*[given[c].alias(c) if c in given else none(c) for c in events.columns]))


def failed_tasks(folded: DataFrame) -> DataFrame:
    """task_id, failed: whether a permanent failure of any of its nodes has ended the task."""
    return folded.groupBy("task_id").agg(F.bool_or("task_failed").alias("failed"))
