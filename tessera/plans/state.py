"""Registered queries of the state machine: graphs made from orders, status events made from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import artifacts, events, graph, metrics, reliability, schedule, sinks
from ..operators.coordination import FUNCTIONS
from ..sources.tables import scan
from .bindings import NOW_MS, ORACLES, QUERIES, query

# ---------------------------------------------------------------------------------------------------------------------
# A graph for each customer: orders are nodes, which depend on the two orders before and, some, on one that is unknown

_NODES = f"""
g AS (SELECT o_custkey AS task_id, o_orderkey AS node_id,
  CASE WHEN o_orderkey % 10 = 6 THEN 'coordinator_fn' ELSE concat('step', o_orderkey % 3) END AS type,
  CASE WHEN o_orderkey % 9 = 4 THEN 'deferred' WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'finished' WHEN o_orderkey % 4 = 1 THEN 'running' ELSE 'queued' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'any' WHEN 1 THEN 'count:2' WHEN 2 THEN 'COUNT:1' WHEN 3 THEN 'most' WHEN 4 THEN 'count:x' WHEN 5 THEN 'ALL' END AS fan_in,
  CASE WHEN o_orderkey % 8 = 3 THEN 'First_Batch' END AS start_when,
  CAST(o_orderkey % 5 AS INT) AS attempt_epoch,
  {NOW_MS} + CASE WHEN o_orderkey % 2 = 0 THEN -1000 ELSE 1000 END AS next_retry_ms,
  {NOW_MS} - (o_orderkey % 20) * 1000 AS last_event_ms,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('w', o_orderkey % 4) END AS lease_worker,
  CASE o_orderkey % 30 WHEN 6 THEN 'vars.set' WHEN 16 THEN 'unknown' END AS fn,
  CASE WHEN o_orderkey % 4 = 0 THEN 60 END AS backoff_sec,
  o_orderkey % 12 = 1 AS started_on_first_batch,
  lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p1,
  lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p2,
  CASE WHEN o_orderkey % 11 = 0 THEN -1 END AS p3
  FROM orders)"""

_TASKS = "SELECT c_custkey AS task_id, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'deferred' ELSE 'finished' END AS status, c_custkey % 13 = 0 AS cancelled FROM customer"
_ARTIFACTS = "SELECT l_orderkey AS node_id, CASE l_returnflag WHEN 'A' THEN 'partial' WHEN 'N' THEN 'failed' ELSE CASE WHEN l_quantity > 45 THEN 'complete' ELSE 'partial' END END AS status FROM lineitem WHERE l_linenumber <= 2"
_SNAPSHOTS = "SELECT l_orderkey AS node_id, concat('w', l_suppkey % 4) AS worker_id, CASE l_returnflag WHEN 'A' THEN 'running' WHEN 'N' THEN 'finishing' ELSE 'idle' END AS run_state, CAST(l_linenumber % 5 AS INT) AS attempt_epoch, l_quantity = 50 AS complete FROM lineitem"

#: deps, readiness, and nodes that are due, in plain SQL.
_READY = f"""{_NODES},
d AS (SELECT task_id, node_id, unnest([p1, p2, p3]) AS dep FROM g),
dd AS (SELECT d.task_id, d.node_id, d.dep, s.status AS dep_status FROM d LEFT JOIN g s ON s.task_id = d.task_id AND s.node_id = d.dep WHERE d.dep IS NOT NULL),
c AS (SELECT g.task_id, g.node_id, count(dep) AS n_deps, CAST(count(*) FILTER (WHERE dep_status = 'finished') AS BIGINT) AS n_finished FROM g LEFT JOIN dd USING (task_id, node_id) GROUP BY 1, 2),
art AS ({_ARTIFACTS}),
r AS (SELECT g.*, n_deps, n_finished,
  CASE lower(coalesce(fan_in, 'all')) WHEN 'all' THEN n_finished = n_deps WHEN 'any' THEN n_finished > 0 WHEN 'count:2' THEN n_finished >= 2 WHEN 'count:1' THEN n_finished >= 1 WHEN 'count:x' THEN n_finished >= n_deps ELSE FALSE END AS met,
  EXISTS (SELECT 1 FROM art WHERE art.status IN ('partial', 'complete') AND ((g.node_id % 16 = 3 AND p2 IS NOT NULL AND art.node_id = p2) OR (NOT (g.node_id % 16 = 3 AND p2 IS NOT NULL) AND art.node_id IN (p1, p2, p3)))) AS batch
  FROM g JOIN c USING (task_id, node_id)),
due AS (SELECT * FROM r WHERE (status = 'queued' OR (status = 'deferred' AND next_retry_ms <= {NOW_MS})) AND CASE WHEN lower(start_when) = 'first_batch' THEN batch ELSE met END)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = scan(spark, sf_dir, "orders").withColumns({"p1": F.lag("o_orderkey", 1).over(w), "p2": F.lag("o_orderkey", 2).over(w), "p3": F.when(k % 11 == 0, F.lit(-1).cast("long"))})
    fan_in = F.element_at(F.array(*map(F.lit, ["any", "count:2", "COUNT:1", "most", "count:x", "ALL", None])), (k % 7 + 1).cast("int"))
    return rows.select(
        F.col("o_custkey").alias("task_id"),
        k.alias("node_id"),
        F.when(k % 10 == 6, "coordinator_fn").otherwise(F.concat(F.lit("step"), (k % 3).cast("string"))).alias("type"),
        F.array_compact(F.array("p1", "p2", "p3")).alias("depends_on"),
        F.when((k % 16 == 3) & F.col("p2").isNotNull(), F.array("p2")).alias("from_nodes"),
        fan_in.alias("fan_in"),
        F.when(k % 8 == 3, "First_Batch").alias("start_when"),
        F.when(k % 9 == 4, "deferred").when((F.col("o_orderstatus") == "F") & (k % 3 != 0), "finished").when(k % 4 == 1, "running").otherwise("queued").alias("status"),
        (k % 5).cast("int").alias("attempt_epoch"),
        (NOW_MS + F.when(k % 2 == 0, -1000).otherwise(1000)).cast("long").alias("next_retry_ms"),
        F.when(k % 4 == 0, F.lit(60)).alias("backoff_sec"),
        F.when(k % 30 == 6, "vars.set").when(k % 30 == 16, "unknown").alias("fn"),
        F.when(k % 2 == 0, F.concat(F.lit("w"), (k % 4).cast("string"))).alias("lease_worker"),
        (NOW_MS - (k % 20) * 1000).cast("long").alias("last_event_ms"),
        (k % 12 == 1).alias("started_on_first_batch"),
    )


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "running").when(k % 4 == 1, "queued").when(k % 4 == 2, "deferred").otherwise("finished")
    return scan(spark, sf_dir, "customer").select(k.alias("task_id"), status.alias("status"), (k % 13 == 0).alias("cancelled"))


def _owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("task_id"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "partial").when(F.col("l_returnflag") == "N", "failed").when(F.col("l_quantity") > 45, "complete").otherwise("partial")
    rows = scan(spark, sf_dir, "lineitem", F.col("l_linenumber") <= 2).select(F.col("l_orderkey").alias("node_id"), status.alias("status"))
    return rows.join(_owner(spark, sf_dir), "node_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "A", "running").when(F.col("l_returnflag") == "N", "finishing").otherwise("idle")
    rows = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string")).alias("worker_id"), state.alias("run_state"), (F.col("l_linenumber") % 5).cast("int").alias("attempt_epoch"), (F.col("l_quantity") == 50).alias("complete"))
    return rows.join(_owner(spark, sf_dir), "node_id")


@query(f"WITH {_READY} SELECT task_id, node_id, dep, dep_status FROM dd UNION ALL SELECT task_id, node_id, NULL, NULL FROM c WHERE n_deps = 0")
def j2_dependency_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_states(_nodes(spark, sf_dir)).select("task_id", "node_id", "dep", "dep_status")


def _rule(name: str, test: str) -> None:
    def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _nodes(spark, sf_dir)
        wanted = nodes.where(test).select("task_id", "node_id")
        return graph.fan_in(graph.dependency_states(nodes).join(wanted, ["task_id", "node_id"], "left_semi"), ["node_id"], F.col("fan_in"))

    QUERIES[name] = rule
    ORACLES[name] = f"WITH {_READY} SELECT node_id, n_deps, n_finished, met AS ready FROM r WHERE {test}"


_rule("a4_all_of_graph", "(fan_in IS NULL OR fan_in = 'ALL')")
_rule("a5_any_of_graph", "fan_in = 'any'")
_rule("a6_count_of_graph", "fan_in IN ('count:2', 'COUNT:1', 'count:x')")
_rule("a7_unknown_rule", "fan_in = 'most'")


@query(f"WITH {_READY} SELECT task_id, node_id FROM due")
def m10_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ready(_nodes(spark, sf_dir), _made(spark, sf_dir), NOW_MS)


@query(f"WITH {_READY} SELECT task_id, node_id FROM due WHERE lower(start_when) = 'first_batch'")
def t3_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.ready(nodes, _made(spark, sf_dir), NOW_MS).join(nodes.where("start_when IS NOT NULL").select("task_id", "node_id"), ["task_id", "node_id"], "left_semi")


@query(f"WITH {_READY} SELECT r.node_id, CASE WHEN due.node_id IS NOT NULL THEN 'running' ELSE r.status END AS status, CAST(r.attempt_epoch + CASE WHEN due.node_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS attempt_epoch FROM r LEFT JOIN due ON r.node_id = due.node_id")
def m11_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.start(nodes, graph.ready(nodes, _made(spark, sf_dir), NOW_MS)).select("node_id", "status", "attempt_epoch")


_ADOPTED = "EXISTS (SELECT 1 FROM snap WHERE snap.node_id = x.node_id AND run_state IN ('running', 'finishing') AND snap.attempt_epoch = x.attempt_epoch AND snap.worker_id = x.lease_worker)"


@query(f"WITH {_NODES}, snap AS ({_SNAPSHOTS}) SELECT node_id FROM g x WHERE {_ADOPTED}")
def j7_adoptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adoptable(_nodes(spark, sf_dir), _snapshots(spark, sf_dir)).select("node_id")


_DECIDED = f"""{_READY}, snap AS ({_SNAPSHOTS}),
x AS (SELECT due.* FROM due JOIN ({_TASKS}) t ON t.task_id = due.task_id WHERE t.status IN ('running', 'queued', 'deferred') AND NOT t.cancelled),
y AS (SELECT *, CASE WHEN type = 'coordinator_fn' THEN 'function'
  WHEN EXISTS (SELECT 1 FROM art WHERE art.node_id = x.node_id AND art.status = 'complete') THEN 'complete' WHEN {_ADOPTED} THEN 'adopt'
  WHEN EXISTS (SELECT 1 FROM snap WHERE snap.node_id = x.node_id AND complete) THEN 'complete_snapshot'
  WHEN status <> 'deferred' AND greatest(0, {NOW_MS} - last_event_ms) < 8000 THEN 'gated' ELSE 'start' END AS decision FROM x),
z AS (SELECT task_id, node_id, type, decision,
  CASE decision WHEN 'function' THEN CASE WHEN fn = 'unknown' THEN 'deferred' ELSE 'finished' END WHEN 'complete' THEN 'finished' WHEN 'complete_snapshot' THEN 'finished' WHEN 'gated' THEN status ELSE 'running' END AS new_status,
  CAST(attempt_epoch + CASE WHEN decision IN ('adopt', 'gated') THEN 0 ELSE 1 END AS INT) AS new_epoch,
  CASE WHEN decision = 'function' AND fn = 'unknown' THEN {NOW_MS} + coalesce(backoff_sec, 300) * 1000 END AS new_retry_ms FROM y)"""


def _tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.tick(_tasks(spark, sf_dir), _nodes(spark, sf_dir), _made(spark, sf_dir), _snapshots(spark, sf_dir), set(FUNCTIONS), NOW_MS)


@query(f"WITH {_DECIDED} SELECT task_id, node_id, decision, new_status, new_epoch, CAST(new_retry_ms AS BIGINT) AS new_retry_ms FROM z")
def m9_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick(spark, sf_dir)


@query(f"WITH {_DECIDED} SELECT node_id, decision, new_status FROM z WHERE decision <> 'function'")
def m13_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made = _nodes(spark, sf_dir), _made(spark, sf_dir)
    due = nodes.join(graph.ready(nodes, made, NOW_MS), ["task_id", "node_id"], "left_semi").join(schedule.open_tasks(_tasks(spark, sf_dir)).select("task_id"), "task_id", "left_semi")
    return schedule.decided(schedule.preflight(due.where("type <> 'coordinator_fn'"), made, _snapshots(spark, sf_dir), NOW_MS)).select("node_id", "decision", "new_status")


@query(f"WITH {_DECIDED} SELECT node_id, new_status, new_epoch, CAST(new_retry_ms AS BIGINT) AS new_retry_ms FROM z WHERE decision = 'function'")
def m12_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick(spark, sf_dir).where("decision = 'function'").select("node_id", "new_status", "new_epoch", "new_retry_ms")


@query(f"WITH {_DECIDED} SELECT g.node_id, coalesce(z.new_status, g.status) AS status, coalesce(z.new_epoch, g.attempt_epoch) AS attempt_epoch, CAST(coalesce(z.new_retry_ms, g.next_retry_ms) AS BIGINT) AS next_retry_ms FROM g LEFT JOIN z ON g.node_id = z.node_id")
def n9_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.applied(_nodes(spark, sf_dir), _tick(spark, sf_dir)).select("node_id", "status", "attempt_epoch", "next_retry_ms")


@query(f"WITH {_DECIDED} SELECT node_id, concat('cmd.', type, '.v1') AS topic, concat(task_id, ':', node_id) AS key, sha256(CAST(to_json(['TASK_START', CAST(task_id AS VARCHAR), CAST(node_id AS VARCHAR), CAST(new_epoch AS VARCHAR)]) AS VARCHAR)) AS dedup_id FROM z WHERE decision = 'start'")
def f11_start_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.start_commands(_tick(spark, sf_dir), _nodes(spark, sf_dir)).select("node_id", "topic", "key", "dedup_id")


_BATCHES = "SELECT DISTINCT o_custkey AS task_id, l_orderkey AS src FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_quantity > 25"


@query(f"""WITH {_READY}, b AS ({_BATCHES}),
e AS (SELECT task_id, p1 AS src, node_id, node_id % 3 = 0 AS asy FROM g WHERE p1 IS NOT NULL UNION ALL SELECT task_id, p2, node_id, FALSE FROM g WHERE p2 IS NOT NULL),
h AS (SELECT e.task_id, e.node_id, bool_or(asy) AS rule_async FROM e JOIN b USING (task_id, src) JOIN ({_TASKS}) t ON t.task_id = e.task_id WHERE NOT cancelled GROUP BY 1, 2)
SELECT r.node_id, rule_async OR CASE WHEN lower(start_when) = 'first_batch' THEN batch ELSE met END AS go
FROM h JOIN r USING (task_id, node_id) WHERE status IN ('queued', 'deferred') AND NOT started_on_first_batch AND (rule_async OR coalesce(lower(start_when) = 'first_batch', FALSE))""")
def t4_on_first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    up = lambda i: nodes.where(F.size("depends_on") > i).withColumn("src", F.get("depends_on", F.lit(i))).where("src >= 0")
    edges = up(0).select("task_id", "src", F.col("node_id").alias("dst"), F.when(F.col("node_id") % 3 == 0, "async").alias("mode"), F.lit("on_batch").alias("trigger"))
    edges = edges.union(up(1).select("task_id", "src", F.col("node_id").alias("dst"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    batches = scan(spark, sf_dir, "lineitem", "l_returnflag <> 'R' AND l_quantity > 25").select(F.col("l_orderkey").alias("node_id")).join(_owner(spark, sf_dir), "node_id")
    return schedule.on_first_batch(batches, _tasks(spark, sf_dir), nodes, edges, _made(spark, sf_dir), NOW_MS).select("node_id", "go")


@query("SELECT c_custkey AS task_id, 'queued' AS status, c_name AS params, CAST(1 AS INTEGER) AS entries FROM customer")
def m16_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("params"))
    return schedule.created(rows, NOW_MS).select("task_id", "status", "params", F.size("history").alias("entries"))


@query("SELECT DISTINCT s_nationkey * 100 + s_suppkey AS task_id, (s_nationkey * 100 + s_suppkey) IN (SELECT c_custkey FROM customer) AS accepted FROM supplier")
def m15_cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scan(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 100 + F.col("s_suppkey")).alias("task_id"), F.lit("user_request").alias("reason"))
    return schedule.cancel_tasks(_tasks(spark, sf_dir), asked)[1]


@query(f"WITH {_NODES} SELECT node_id, lease_worker AS target_worker_id, {NOW_MS} + 30000 AS deadline_ms FROM g WHERE status IN ('queued', 'running', 'deferred') AND lease_worker IS NOT NULL AND task_id % 5 = 0")
def r5_cancel_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.cancel_signals(_nodes(spark, sf_dir).where("task_id % 5 = 0"), 30_000, NOW_MS).select("node_id", "target_worker_id", "deadline_ms")


@query(f"WITH {_NODES}, t AS ({_TASKS}) SELECT task_id, count(*) AS n_nodes, bool_and(g.status = 'finished') OR (any_value(cancelled) AND bool_and(g.status IN ('finished', 'failed', 'deferred'))) AS finished FROM g JOIN t USING (task_id) WHERE node_id % 3 <> 0 AND node_id % 4 <> 1 GROUP BY 1")
def a8_cancelled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).where("node_id % 3 <> 0 AND node_id % 4 <> 1").join(_tasks(spark, sf_dir).select("task_id", "cancelled"), "task_id")
    return graph.finalized(rows, ["task_id"], F.col("cancelled"))


@query(f"""WITH {_NODES}, e AS (SELECT task_id, p2 AS src, node_id AS dst, 0 AS kind FROM g WHERE p2 IS NOT NULL UNION ALL SELECT task_id, p1, node_id, 1 FROM g WHERE p1 IS NOT NULL UNION ALL SELECT task_id, p2, node_id, 1 FROM g WHERE p2 IS NOT NULL),
f AS (SELECT src, dst, min(kind) AS kind FROM e GROUP BY 1, 2) SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY kind, dst) AS children FROM f GROUP BY 1""")
def j5_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    edge = lambda i: nodes.withColumn("src", F.get("depends_on", F.lit(i))).where("src >= 0").select("src", F.col("node_id").alias("dst"), F.col("node_id").alias("at"))
    out = graph.ordered_children(edge(1), edge(0).union(edge(1)), "at")
    return out.select("src", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


# ---------------------------------------------------------------------------------------------------------------------
# Status events: users are nodes of 40 tasks

_EVENTS = f"""
k AS (SELECT event_id AS seq, user_id AS node, user_id % 40 AS task, (epoch_us(ts) // 1000) AS ms,
  CASE event_type WHEN 'signup' THEN 'TASK_START' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'BATCH_OK' ELSE 'TASK_HEARTBEAT' END WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'TASK_ACCEPTED' ELSE 'BATCH_FAILED' END
   WHEN 'purchase' THEN 'BATCH_OK' ELSE CASE WHEN event_id % 12 = 0 THEN 'TASK_DONE' WHEN event_id % 4 = 1 THEN 'CANCELLED' ELSE 'TASK_FAILED' END END AS kind,
  event_id % 31 = 2 AS permanent, CAST(event_id % 10 AS VARCHAR) AS uid, concat('w', event_id % 3) AS worker, CASE WHEN event_id % 5 <> 0 THEN (epoch_us(ts) // 1000) + 60000 END AS deadline FROM events),
e0 AS (SELECT *, CAST(1 + coalesce(sum(CASE WHEN kind IN ('TASK_FAILED', 'CANCELLED') THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END AS INT) AS epoch FROM k)"""


def _fold_sql(source: str, name: str) -> str:
    """The fold as a recursive query over each node's events in order."""
    live = "(e.kind NOT IN ('TASK_START', 'TASK_CANCEL') AND e.epoch = s.epoch AND (e.kind NOT IN ('TASK_ACCEPTED', 'TASK_HEARTBEAT', 'BATCH_OK', 'BATCH_FAILED', 'TASK_DONE') OR s.status = 'running'))"
    begins = "(e.kind = 'TASK_START' AND s.status IN ('queued', 'deferred') AND e.epoch = s.epoch + 1)"
    opened = "s.status IN ('queued', 'running', 'deferred')"
    new = "NOT list_contains(s.ok, e.uid) AND NOT list_contains(s.bad, e.uid)"
    lease = f"({live} AND e.kind IN ('TASK_ACCEPTED', 'TASK_HEARTBEAT'))"
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY task, node ORDER BY ms, seq, kind) AS rn FROM {source}),
{name}_f AS (SELECT DISTINCT task, node, CAST(0 AS BIGINT) AS rn, 'queued' AS status, CAST(0 AS INT) AS epoch, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS retry, CAST([] AS VARCHAR[]) AS ok, CAST([] AS VARCHAR[]) AS bad, CAST(NULL AS BIGINT) AS fail_ms, CAST(NULL AS BIGINT) AS fail_seq FROM {source}
 UNION ALL SELECT s.task, s.node, e.rn,
  CASE WHEN {begins} THEN 'running' WHEN e.kind = 'TASK_CANCEL' THEN CASE WHEN {opened} THEN 'cancelling' ELSE s.status END WHEN NOT {live} THEN s.status WHEN e.kind = 'TASK_DONE' THEN 'finished'
   WHEN e.kind = 'TASK_FAILED' AND e.permanent THEN CASE WHEN {opened} THEN 'cancelling' ELSE s.status END WHEN e.kind IN ('TASK_FAILED', 'CANCELLED') THEN 'deferred' ELSE s.status END,
  CASE WHEN {begins} THEN e.epoch ELSE s.epoch END,
  CASE WHEN {lease} THEN e.worker ELSE s.worker END,
  CASE WHEN {lease} AND e.deadline IS NOT NULL THEN CASE WHEN s.deadline IS NULL OR e.kind = 'TASK_ACCEPTED' THEN e.deadline ELSE greatest(s.deadline, e.deadline) END ELSE s.deadline END,
  CASE WHEN {live} THEN greatest(coalesce(s.last, e.ms), e.ms) ELSE s.last END,
  CASE WHEN {begins} THEN NULL WHEN {live} AND e.kind = 'TASK_FAILED' AND NOT e.permanent THEN e.ms + 300000 ELSE s.retry END,
  CASE WHEN {live} AND e.kind = 'BATCH_OK' AND {new} THEN list_append(s.ok, e.uid) ELSE s.ok END,
  CASE WHEN {live} AND e.kind = 'BATCH_FAILED' AND {new} THEN list_append(s.bad, e.uid) ELSE s.bad END,
  CASE WHEN {live} AND e.kind = 'TASK_FAILED' AND e.permanent THEN coalesce(s.fail_ms, e.ms) ELSE s.fail_ms END,
  CASE WHEN {live} AND e.kind = 'TASK_FAILED' AND e.permanent THEN coalesce(s.fail_seq, e.seq) ELSE s.fail_seq END
  FROM {name}_f s JOIN {name}_o e ON e.task = s.task AND e.node = s.node AND e.rn = s.rn + 1),
{name} AS (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY task, node ORDER BY rn DESC) = 1)"""


_FOLDED = f"WITH RECURSIVE {_EVENTS}, {_fold_sql('e0', 'a')}"
_CASCADED = f"""{_FOLDED}, stop AS (SELECT task, min((fail_ms, fail_seq)) AS pos FROM a WHERE fail_ms IS NOT NULL GROUP BY 1),
e1 AS (SELECT task, node, ms, seq, kind, permanent, uid, worker, deadline, epoch FROM e0
 UNION ALL SELECT DISTINCT e0.task, e0.node, pos[1], pos[2], 'TASK_CANCEL', CAST(NULL AS BOOLEAN), NULL, NULL, CAST(NULL AS BIGINT), CAST(NULL AS INT) FROM e0 JOIN stop USING (task)), {_fold_sql('e1', 'b')}"""


def _status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import epoch_ms

    i, kind_of = F.col("event_id"), F.col("event_type")
    kind = F.when(kind_of == "signup", "TASK_START").when(kind_of == "click", F.when(i % 2 == 0, "BATCH_OK").otherwise("TASK_HEARTBEAT")).when(kind_of == "view", F.when(i % 3 == 0, "TASK_ACCEPTED").otherwise("BATCH_FAILED"))
    kind = kind.when(kind_of == "purchase", "BATCH_OK").otherwise(F.when(i % 12 == 0, "TASK_DONE").when(i % 4 == 1, "CANCELLED").otherwise("TASK_FAILED"))
    rows = scan(spark, sf_dir, "events").withColumn("ms", epoch_ms("ts")).withColumn("kind", kind)
    before = Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    epoch = 1 + F.coalesce(F.sum(F.col("kind").isin("TASK_FAILED", "CANCELLED").cast("int")).over(before), F.lit(0)) - (i % 17 == 0).cast("int")
    return rows.select(
        (F.col("user_id") % 40).cast("string").alias("task_id"), F.col("user_id").cast("string").alias("node_id"), "kind", epoch.cast("int").alias("epoch"), F.col("ms").alias("recv_ts_ms"), i.alias("seq"),
        F.concat(F.lit("w"), (i % 3).cast("string")).alias("worker_id"), F.when(i % 5 != 0, F.col("ms") + 60_000).alias("deadline_ms"), (i % 10).cast("string").alias("batch_uid"), (i % 31 == 2).alias("permanent"),
    )


_NODE_COLUMNS = "CAST(task AS VARCHAR) AS task_id, CAST(node AS VARCHAR) AS node_id"


@query(f"{_FOLDED} SELECT {_NODE_COLUMNS}, status, epoch, worker AS worker_id, deadline AS lease_deadline_ms, last AS last_event_ms, len(ok) AS batches_ok, len(bad) AS batches_failed, retry AS next_retry_ms, fail_ms IS NOT NULL AS task_failed FROM a")
def m3_fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.fold_state(_status_events(spark, sf_dir)).drop("failed_ms", "failed_seq")


def _fold_part(name: str, columns: dict[str, str]) -> None:
    sql = f"{_FOLDED} SELECT {_NODE_COLUMNS}, {', '.join(f'{s} AS {c}' for c, s in columns.items())} FROM a"
    QUERIES[name] = lambda spark, sf_dir: events.fold_state(_status_events(spark, sf_dir)).select("task_id", "node_id", *columns)
    ORACLES[name] = sql


_fold_part("m1_accepted", {"worker_id": "worker", "lease_deadline_ms": "deadline"})
_fold_part("m4_batches_failed", {"batches_failed": "len(bad)"})
_fold_part("m5_done", {"status": "status", "epoch": "epoch"})
_fold_part("m7_deferred", {"next_retry_ms": "retry", "status": "status"})
_fold_part("m8_cancelled", {"status": "status", "last_event_ms": "last"})


@query(f"{_CASCADED} SELECT {_NODE_COLUMNS}, status, len(ok) AS batches_ok, fail_ms IS NOT NULL AS task_failed FROM b")
def m6_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.fold_state(events.with_cascade(_status_events(spark, sf_dir))).select("task_id", "node_id", "status", "batches_ok", "task_failed")


_SINK = "l AS (SELECT l_orderkey AS t, l_suppkey % 4 AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS q, l_linenumber % 3 AS b, l_returnflag AS f, l_quantity AS v FROM lineitem)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = scan(spark, sf_dir, "lineitem").withColumn("q", F.row_number().over(w).cast("long"))
    flag = F.col("l_returnflag")
    some = F.col("l_quantity") > 5
    return rows.select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 4).alias("node_id"),
        F.when(flag == "A", "BATCH_OK").when(flag == "N", "BATCH_FAILED").otherwise("TASK_DONE").alias("kind"),
        F.when(flag != "R", (F.col("l_linenumber") % 3).cast("string")).alias("batch_uid"),
        F.when(some, F.create_map(F.lit("q"), F.col("l_quantity").cast("decimal(18,2)").cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("metrics"),
        F.when(F.col("l_quantity") > 10, "ref").alias("artifacts_ref"), F.when(flag == "N", "bad").alias("reason"), F.lit(1).alias("epoch"), F.col("q").alias("ts_ms"), F.col("q").alias("seq"),
    )


@query(f"""WITH {_SINK}, m AS (SELECT t, n, CASE WHEN f = 'R' THEN '__final__' ELSE CAST(b AS VARCHAR) END AS uid, q, f, CASE WHEN f <> 'N' THEN CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM l WHERE f = 'N' OR v > 5)
SELECT t AS task_id, n AS node_id, uid AS batch_uid, f = 'N' AS failed, f = 'R' AS final, CASE WHEN f = 'N' THEN 'bad' END AS reason, v FROM m QUALIFY row_number() OVER (PARTITION BY t, n, uid ORDER BY q) = 1""")
def k5_metric_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.recorded(sinks.metric_writes(_outcomes(spark, sf_dir)), ["seq"])
    return out.select("task_id", "node_id", "batch_uid", "failed", "final", "reason", F.element_at("metrics", F.lit("q")).alias("v"))


@query(f"""WITH {_SINK}, a AS (SELECT t, n, CASE WHEN f <> 'R' THEN CAST(b AS VARCHAR) END AS uid, q, CASE f WHEN 'A' THEN 'partial' WHEN 'N' THEN 'failed' ELSE 'complete' END AS status FROM l WHERE f = 'N' OR v > 10)
SELECT t AS task_id, n AS node_id, uid AS batch_uid, min(q) AS created_seq, max(q) AS updated_seq, arg_max(status, q) AS status, count(*) AS writes FROM a GROUP BY 1, 2, 3""")
def k6_artifact_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.upserted(sinks.artifact_writes(_outcomes(spark, sf_dir))).select("task_id", "node_id", "batch_uid", "created_seq", "updated_seq", "status", "writes")


@query(f"WITH {_SINK} SELECT t AS task_id, n AS node_id, max(q) AS updated_seq, concat('{{\"task_id\":', t, ',\"node_id\":', n, '}}') AS ref FROM l WHERE f = 'R' AND v > 10 GROUP BY 1, 2")
def k2_mark_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = artifacts.upserted(sinks.artifact_writes(_outcomes(spark, sf_dir).where("kind = 'TASK_DONE'")))
    return done.select("task_id", "node_id", "updated_seq", sinks.complete_ref(F.lit(None), F.col("task_id"), F.col("node_id")).alias("ref"))


@query(f"""WITH e AS (SELECT l_orderkey AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey AS node_id, s AS qty, CASE WHEN s IS NOT NULL THEN {NOW_MS} END AS stats_cached_at FROM orders LEFT JOIN e ON t = o_orderkey""")
def k13_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem", "l_returnflag = 'A'").select(F.lit("t").alias("task_id"), F.col("l_orderkey").alias("node_id"), F.lit(None).cast("boolean").alias("failed"), F.create_map(F.lit("q"), F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("metrics"))
    stats = metrics.as_maps(metrics.aggregate(rows, "sum", exact_scale=2))
    nodes = scan(spark, sf_dir, "orders").select(F.lit("t").alias("task_id"), F.col("o_orderkey").alias("node_id"), F.lit(None).cast("map<string,double>").alias("stats"), F.lit(None).cast("long").alias("stats_cached_at"))
    return sinks.with_stats(nodes, stats, NOW_MS).select("node_id", F.element_at("stats", F.lit("q")).alias("qty"), "stats_cached_at")


_ANNOUNCED = "CASE event_type WHEN 'signup' THEN 'WORKER_ONLINE' WHEN 'error' THEN 'WORKER_OFFLINE' ELSE 'WORKER_HEARTBEAT' END"


@query(f"""WITH e AS (SELECT user_id AS w, {_ANNOUNCED} AS kind, (ts, event_id) AS pos, concat('t', event_id % 5) AS type, ts FROM events WHERE event_id % 9 < 4),
f AS (SELECT w, min(pos) AS first FROM e WHERE kind <> 'WORKER_OFFLINE' GROUP BY 1)
SELECT w AS worker_id, arg_max(type, pos) FILTER (WHERE kind = 'WORKER_ONLINE') AS type, CASE arg_max(kind, pos) FILTER (WHERE kind <> 'WORKER_HEARTBEAT') WHEN 'WORKER_ONLINE' THEN 'online' WHEN 'WORKER_OFFLINE' THEN 'offline' END AS status, max(ts) AS last_seen
FROM e JOIN f USING (w) WHERE pos >= first GROUP BY 1""")
def k10_worker_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "WORKER_ONLINE").when(F.col("event_type") == "error", "WORKER_OFFLINE").otherwise("WORKER_HEARTBEAT")
    rows = scan(spark, sf_dir, "events", "event_id % 9 < 4").select(F.col("user_id").alias("worker_id"), kind.alias("kind"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("type"), F.struct("ts", "event_id").alias("at"))
    return sinks.worker_registry(rows).select("worker_id", "type", "status", F.col("last_seen.ts").alias("last_seen"))


@query("WITH e AS (SELECT user_id AS w, (ts, event_id) AS pos, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS run FROM events) SELECT w AS worker_id, max(pos)[2] AS at_id, list(run ORDER BY pos DESC)[1] AS run FROM e GROUP BY 1")
def k11_worker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("run"))
    return sinks.active_runs(rows).select("worker_id", "run", F.col("updated_at.event_id").alias("at_id"))


@query("WITH e AS (SELECT user_id AS w, (ts, event_id) AS pos, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS run FROM events), x AS (SELECT w, list(run ORDER BY pos DESC)[1] AS run FROM e GROUP BY 1) SELECT w AS worker_id, run FROM x WHERE run IS NOT NULL")
def r9_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("run"))
    return sinks.resumable(sinks.active_runs(rows)).select("worker_id", "run")


def _refuse_errors(topic: str, key: str, envelope: str) -> None:
    if topic == "error":
        raise ConnectionError(f"no route for {key}")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS fp, CASE WHEN event_type <> 'error' THEN 'sent' WHEN event_id % 14 + 1 >= 12 THEN 'failed' ELSE 'retry' END AS state, CAST(event_id % 14 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS attempts,
CASE WHEN event_type = 'error' THEN concat('no route for ', user_id) END AS last_error, CASE WHEN event_type = 'error' AND event_id % 14 + 1 < 12 THEN {NOW_MS} + CAST(least(60000, greatest(250, pow(2, event_id % 14 + 1) * 100)) AS BIGINT) END AS next_attempt_at_ms FROM events WHERE event_id % 3 = 0""")
def k8_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "event_id % 3 = 0").select(F.col("event_id").cast("string").alias("fp"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.lit("{}").alias("envelope"), (F.col("event_id") % 14).cast("int").alias("attempts"))
    return sinks.dispatch(rows, _refuse_errors, NOW_MS)


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 3 AND (CASE event_id % 4 WHEN 0 THEN (epoch_us(ts) // 1000) WHEN 1 THEN (epoch_us(ts) // 1000) + 1000 ELSE NULL END) <= (SELECT min(epoch_us(ts) // 1000) + 864000000 FROM events) ORDER BY ts, event_id LIMIT 200")
def p4_due_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what is due ten days after the first event; rows without a time are never due."""
    from ..functions.scalars import epoch_ms

    i, ms = F.col("event_id"), epoch_ms("ts")
    now = scan(spark, sf_dir, "events").agg(F.min(ms)).first()[0] + 864_000_000
    at = F.when(i % 4 == 0, ms).when(i % 4 == 1, ms + 1000)
    rows = scan(spark, sf_dir, "events").withColumn("state", F.when(i % 4 == 3, "sent").otherwise("retry")).withColumn("next_attempt_at_ms", at)
    return reliability.due(rows, now, 200, ["ts", "event_id"]).select("event_id", "event_type")
