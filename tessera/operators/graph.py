"""Task graphs: dependency states, fan-in rules, readiness, children, finalisation, cancel cascade, adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import required_count

NODES = "task_id string, node_id string, type string, depends_on array<string>, from_nodes array<string>, fan_in string, start_when string, status string, attempt_epoch int, next_retry_ms long, backoff_sec int, fn string, lease_worker string, last_event_ms long, started_on_first_batch boolean"
EDGES = "task_id string, src string, dst string, mode string, trigger string"
OPEN = ("queued", "running", "deferred")


def to_tables(spark: SparkSession, task_id: str, graph: dict) -> tuple[DataFrame, DataFrame]:
    """A graph document's nodes and edges (plain and extended) as tables."""
    nodes = []
    for n in graph.get("nodes") or []:
        io = n.get("io") or {}
        sources = ((io.get("input_inline") or {}).get("input_args") or {}).get("from_nodes")
        deps, epoch = list(n.get("depends_on") or []), int(n.get("attempt_epoch") or 0)
        nodes.append((task_id, n["node_id"], n.get("type"), deps, sources, n.get("fan_in") or "all", io.get("start_when"), n.get("status") or "queued", epoch, n.get("next_retry_ms"), (n.get("retry_policy") or {}).get("backoff_sec"), io.get("fn"), (n.get("lease") or {}).get("worker_id"), n.get("last_event_ms"), (n.get("streaming") or {}).get("started_on_first_batch")))
    known = [n[1] for n in nodes]
    if len(set(known)) != len(known):
        raise ValueError("node ids must be unique in a graph")
    edges = [(task_id, a, b, None, None) for a, b in graph.get("edges") or []] + [(task_id, e["from"], e["to"], e.get("mode"), e.get("trigger")) for e in graph.get("edges_ex") or []]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def dependency_states(nodes: DataFrame) -> DataFrame:
    """A row for each node and dependency with its status: null for an unknown dependency; one row without for none."""
    wanted = nodes.select("task_id", "node_id", F.lower(F.coalesce("fan_in", F.lit("all"))).alias("fan_in"), F.explode_outer("depends_on").alias("dep"))
    states = nodes.select("task_id", F.col("node_id").alias("dep"), F.col("status").alias("dep_status"))
    return wanted.join(states, ["task_id", "dep"], "left")


def fan_in_met(rule: Column, finished: Column, size: Column) -> Column:
    """all: every dependency (true for none); any: one (false for none); count:n: at least n; other rules: never."""
    return F.coalesce(
        F.when(rule == "all", finished == size).when(rule == "any", finished > 0).when(rule.startswith("count:"), finished >= required_count(rule, size)).otherwise(F.lit(False)),
        F.lit(False),
    )


def fan_in(states: DataFrame, keys: list[str], rule: str | Column, dep: str = "dep", status: str = "dep_status") -> DataFrame:
    """keys, n_deps, n_finished, ready from one row for each dependency (dep null where there is none)."""
    rule = F.lit(rule.lower()) if isinstance(rule, str) else rule
    counts = states.groupBy(*keys).agg(F.count(dep).alias("n_deps"), F.count_if(F.col(dep).isNotNull() & (F.col(status) == "finished")).alias("n_finished"), F.first(rule).alias("_rule"))
    return counts.select(*keys, "n_deps", "n_finished", fan_in_met(F.col("_rule"), F.col("n_finished"), F.col("n_deps")).alias("ready"))


def first_batch_available(consumers: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Consumers any of whose sources has a partial or complete artifact."""
    return consumers.join(artifacts.where(F.col("status").isin("partial", "complete")), keys, "left_semi")


def ready(nodes: DataFrame, artifacts: DataFrame, now_ms: int) -> DataFrame:
    """Nodes that may start: queued, or deferred with their retry due; first_batch nodes by artifacts alone.

    A first_batch node looks at the sources of its input, where it names any, else at its dependencies.
    """
    due = (F.col("status") == "queued") | ((F.col("status") == "deferred") & (F.coalesce("next_retry_ms", F.lit(0)) <= now_ms))
    open_nodes = nodes.where(due)
    waiting = F.lower("start_when") == "first_batch"
    sources = F.when(F.size("from_nodes") > 0, F.col("from_nodes")).otherwise(F.col("depends_on"))
    early = open_nodes.where(waiting).select("task_id", "node_id", F.explode(sources).alias("dep"))
    started = artifacts.where(F.col("status").isin("partial", "complete")).select("task_id", F.col("node_id").alias("dep"))
    by_batch = early.join(started, ["task_id", "dep"], "left_semi").select("task_id", "node_id").distinct()
    rules = fan_in(dependency_states(nodes), ["task_id", "node_id"], F.col("fan_in")).where("ready")
    by_rule = open_nodes.where(~F.coalesce(waiting, F.lit(False))).join(rules, ["task_id", "node_id"], "left_semi").select("task_id", "node_id")
    return by_batch.union(by_rule)


def children(edges: DataFrame, extended: DataFrame) -> DataFrame:
    """Distinct (src, dst) over plain and extended edges."""
    return edges.select("src", "dst").union(extended.select("src", "dst")).distinct()


def ordered_children(edges: DataFrame, extended: DataFrame, at: str) -> DataFrame:
    """src, children: distinct children in the order of at, plain edges before extended ones."""
    both = edges.select("src", "dst", F.lit(0).alias("_kind"), F.col(at).alias("_at")).union(extended.select("src", "dst", F.lit(1).alias("_kind"), F.col(at).alias("_at")))
    first = both.groupBy("src", "dst").agg(F.min(F.struct("_kind", "_at")).alias("_first"))
    return first.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "dst"))), lambda x: x["dst"]).alias("children"))


def distinct_in_order(items: Column) -> Column:
    """An array without repeats; each item stays where it was first."""
    return F.array_distinct(items)


def starts_on_batch(extended: DataFrame) -> DataFrame:
    """(src, dst) pairs with an asynchronous edge that fires on a batch."""
    return extended.where((F.col("mode") == "async") & (F.col("trigger") == "on_batch")).select("src", "dst").distinct()


def finalized(nodes: DataFrame, keys: list[str], cancelled: Column | None = None) -> DataFrame:
    """keys, n_nodes, finished: all nodes finished, or the task cancelled and none of them still to run."""
    done = F.bool_and(F.col("status") == "finished")
    if cancelled is not None:
        done = done | (F.bool_or(cancelled) & F.bool_and(F.col("status").isin("finished", "failed", "deferred")))
    return nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), done.alias("finished"))


def counts_by_status(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of nodes (or tasks) in each status, in all or by keys."""
    return nodes.groupBy(*(keys or []), "status").agg(F.count("*").alias("n"))


def cancel(nodes: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Nodes with new_status: every open node of the given tasks becomes cancelling, whatever its place in the graph."""
    hit = tasks.select(key).distinct().withColumn("_hit", F.lit(True))
    return nodes.join(hit, key, "left").withColumn("new_status", F.when(F.col("_hit") & F.col("status").isin(*OPEN), F.lit("cancelling")).otherwise(F.col("status"))).drop("_hit")


def adoptable(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Live runs to adopt: a running or finishing snapshot of the node's epoch from the worker that held the lease."""
    s = snapshots.where(F.col("run_state").isin("running", "finishing") & F.col("worker_id").isNotNull())
    return nodes.join(s.select("task_id", "node_id", "attempt_epoch", F.col("worker_id").alias("lease_worker")), ["task_id", "node_id", "attempt_epoch", "lease_worker"], "left_semi")


def start(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Compare-and-set start: chosen nodes that are queued or deferred run in the next epoch; others stay."""
    hit = chosen.select("task_id", "node_id").distinct().withColumn("_hit", F.lit(True))
    go = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("status").isin("queued", "deferred")
    out = nodes.join(hit, ["task_id", "node_id"], "left")
    return out.withColumn("attempt_epoch", F.col("attempt_epoch") + go.cast("int")).withColumn("status", F.when(go, F.lit("running")).otherwise(F.col("status"))).drop("_hit")
