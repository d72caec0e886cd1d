"""Registered queries: each operator bound to the test tables, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import artifacts, events, graph, metrics, reliability
from ..operators import vars as tree
from ..sources.handlers import BatchResult, Handler, run_batches
from ..sources.tables import lookup, scan
from ..streaming import status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The literal now of time-dependent queries, as wall clock and milliseconds.
NOW, NOW_MS = "2024-01-20 00:00:00", 1_705_708_800_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_FIRST = "row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("node_id"), F.col("l_linenumber").alias("batch_uid"), (F.col("l_linestatus") == "O").alias("failed"), *_ORDER)


def _with_metrics(rows: DataFrame) -> DataFrame:
    """The metrics are made after the first writes are known, so no map is sorted or shuffled."""
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return rows.withColumn("metrics", F.create_map(F.lit("qty"), text("l_quantity"), F.lit("price"), text("l_extendedprice"), F.lit("list"), F.lit("[1, 2]")))


@query(f"""
WITH m AS (SELECT * FROM lineitem QUALIFY {_FIRST}),
e AS (SELECT l_orderkey AS task_id, l_returnflag AS node_id, 'qty' AS key, CAST(l_quantity AS DECIMAL(18,2)) AS v FROM m WHERE l_linestatus <> 'O'
 UNION ALL SELECT l_orderkey, l_returnflag, 'price', CAST(l_extendedprice AS DECIMAL(18,2)) FROM m WHERE l_linestatus <> 'O')
SELECT task_id, node_id, key, CAST(sum(v) AS DOUBLE) AS value FROM e GROUP BY 1, 2, 3""")
def a1_metrics_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aggregate(_with_metrics(metrics.recorded(_metric_rows(spark, sf_dir), _ORDER)), "sum", exact_scale=2)


@query("""
WITH e AS (SELECT event_type AS node_id, 'value' AS key, CAST(value AS DECIMAL(18,4)) AS v FROM events
 UNION ALL SELECT event_type, 'k', CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS DECIMAL(18,4)) FROM events)
SELECT node_id, key, CAST(sum(v) AS DOUBLE) / count(*) AS value FROM e WHERE v IS NOT NULL GROUP BY 1, 2""")
def a2_metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events").select(
        F.lit("t").alias("task_id"), F.col("event_type").alias("node_id"), F.lit(False).alias("failed"),
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("metrics"),
    )
    return metrics.aggregate(rows, "mean", exact_scale=4).drop("task_id")


def _artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status_of = F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "N", "partial").otherwise("failed")
    return scan(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("task_id"), (F.col("l_suppkey") % 8).cast("string").alias("node_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("batch_uid"), status_of.alias("status"))


@query("""
SELECT l_orderkey % 50 AS task_id, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'A' THEN CAST(l_suppkey % 8 AS VARCHAR) END, ',' ORDER BY CASE WHEN l_returnflag = 'A' THEN CAST(l_suppkey % 8 AS VARCHAR) END), '') AS complete_nodes,
 CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS partial_batches,
 count(DISTINCT CASE WHEN l_returnflag = 'N' THEN concat(l_orderkey, '-', l_linenumber) END) AS distinct_batch_uids
FROM lineitem WHERE l_suppkey % 8 IN (0, 1, 2, 5) GROUP BY 1""")
def a3_merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = artifacts.merge_meta(_artifact_rows(spark, sf_dir), ["0", "1", "2", "5"])
    return out.withColumn("complete_nodes", F.array_join("complete_nodes", ","))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' ELSE 'queued' END"


def _order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("dep"), F.expr(_STATUS).alias("dep_status"))


def _fan_in_sql(test: str) -> str:
    return f"SELECT o_custkey AS task_id, count(*) AS n_deps, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_finished, count(*) FILTER (WHERE o_orderstatus = 'F') {test} AS ready FROM orders GROUP BY 1"


@query(_fan_in_sql("= count(*)"))
def a4_fan_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(_order_states(spark, sf_dir), ["task_id"], "all")


@query(_fan_in_sql("> 0"))
def a5_fan_in_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(_order_states(spark, sf_dir), ["task_id"], "any")


@query(_fan_in_sql(">= 3"))
def a6_fan_in_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(_order_states(spark, sf_dir), ["task_id"], "count:3")


@query("SELECT o_custkey AS task_id, count(*) AS n_nodes, bool_and(o_orderstatus = 'F') OR (bool_or(o_orderpriority LIKE '1%') AND bool_and(o_orderstatus = 'F')) AS finished FROM orders GROUP BY 1")
def a8_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.expr(_STATUS).alias("status"), F.col("o_orderpriority").startswith("1").alias("cancelled"))
    return graph.finalized(rows, ["task_id"], F.col("cancelled"))


def _event_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").withColumn("ts_ms", fn.epoch_ms("ts"))


@query("SELECT user_id, max((epoch_us(ts) // 1000)) AS ts_ms, max(value) AS value FROM events GROUP BY 1")
def a9_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.high_water(_event_ms(spark, sf_dir), ["user_id"], ["ts_ms", "value"])


@query("SELECT event_type, user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def a10_incr(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = scan(spark, sf_dir, "events").select("event_type", "user_id", F.col("value").cast("decimal(18,4)").alias("by"))
    return tree.counters(deltas, ["event_type", "user_id"]).withColumn("value", F.col("value").cast("double"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a12_count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts_by_status(scan(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def d1_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_ORDER)
    return events.first_wins(rows, ["l_orderkey", "l_linenumber"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")


@query("SELECT user_id, user_id % 7 AS shard, event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value >= 10")
def s1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", F.col("event_type").isin("click", "purchase") & (F.col("value") >= 10), ["user_id", "event_id", "event_type"])
    return rows.withColumn("shard", F.col("user_id") % 7)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 7 LIMIT 1")
def s2_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(scan(spark, sf_dir, "events", columns=["event_id", "user_id", "event_type", "value"]), event_id=7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'N'))")
def t3_first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "N", "partial").otherwise("failed").alias("status"))
    return graph.first_batch_available(scan(spark, sf_dir, "orders", columns=["o_orderkey", "o_custkey"]), rows, ["o_orderkey"])


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def p3_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "documents", columns=["doc_id", "lang"]).join(scan(spark, sf_dir, "labels", columns=["doc_id", "toxic"]), "doc_id", "left")
    return rows.where(events.not_value("toxic", 1)).select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST(l_linenumber % 2 AS INTEGER) AS epoch FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = l_linenumber % 2")
def p9_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", (F.col("l_linenumber") % 2).cast("int").alias("epoch"))
    nodes = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 2).cast("int").alias("epoch"))
    return events.fence(rows, nodes, ["l_orderkey"], "epoch")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def j4_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", columns=["event_id", "user_id"])
    return events.unclaimed(rows, rows.where("event_id % 3 = 0").select("event_id"), ["event_id"])


@query("SELECT DISTINCT src, dst FROM (SELECT r_name AS src, n_name AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 1)")
def j5_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scan(spark, sf_dir, "region").join(scan(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    down = both.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), "n_nationkey")
    up = both.where("n_nationkey % 5 = 1").select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return graph.children(down.select("src", "dst"), down.where("n_nationkey % 2 = 0").select("src", "dst").union(up))


@query("SELECT DISTINCT r_name AS src, n_name AS dst FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def j6_async_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scan(spark, sf_dir, "region").join(scan(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    mode = F.when(F.col("n_nationkey") % 3 == 0, "async")
    return graph.starts_on_batch(both.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), mode.alias("mode"), F.lit("on_batch").alias("trigger")))


@query("SELECT a.event_id AS corr_id, b.event_id AS reply_id FROM events a JOIN events b ON a.event_type = 'click' AND b.event_type = 'view' AND a.user_id = b.user_id AND (epoch_us(b.ts) // 1000) BETWEEN (epoch_us(a.ts) // 1000) AND (epoch_us(a.ts) // 1000) + 3600000")
def j8_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_ms(spark, sf_dir)
    asked = rows.where("event_type = 'click'").select(F.col("user_id").alias("corr_id"), "ts_ms", F.col("event_id").alias("asked_id"))
    replies = rows.where("event_type = 'view'").select(F.col("user_id").alias("corr_id"), "ts_ms", F.col("event_id").alias("reply_id"))
    return reliability.replies_in_window(asked, replies, 3_600_000).select(F.col("asked_id").alias("corr_id"), "reply_id")


@query("""
WITH u AS (SELECT user_id, list(event_id ORDER BY event_id) AS items FROM events GROUP BY 1),
c AS (SELECT user_id, unnest(range(0, CAST(ceil(len(items) / 7.0) AS BIGINT))) AS i, items FROM u)
SELECT user_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(items[i * 7 + 1 : i * 7 + 7], ',') AS items, sha256(CAST(to_json(['u', CAST(user_id AS VARCHAR), CAST(i AS VARCHAR)]) AS VARCHAR)) AS chunk_uid FROM c""")
def n1_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = scan(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("list"))
    out = artifacts.rechunk(lists, "list", 7, F.lit("u"), F.col("user_id").cast("string"))
    return out.select("user_id", "chunk_no", F.array_join("chunk", ",").alias("items"), "chunk_uid")


@query("SELECT conv_id, turn, CAST(0 AS INTEGER) AS chunk_no, CAST(1 AS INTEGER) AS n_items FROM conversations")
def n1_rechunk_nokey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "conversations")
    out = artifacts.rechunk(rows, artifacts.single_item(F.struct("role", "text")), 10, F.lit("c"), F.col("conv_id").cast("string"))
    return out.select("conv_id", "turn", "chunk_no", F.size("chunk").alias("n_items"))


def _nation_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.create_map(F.lit("geo.name"), F.to_json(F.struct(F.col("n_name").alias("v"))), F.lit("geo.region"), F.col("n_regionkey").cast("string"), F.lit("runs"), F.col("n_nationkey").cast("string"))
    return scan(spark, sf_dir, "nation").select("n_nationkey", start.alias("v"))


def _leaves(df: DataFrame) -> DataFrame:
    return df.select("n_nationkey", F.explode("v").alias("path", "leaf"))


@query("SELECT n_nationkey, 'geo.region' AS path, CAST(n_regionkey AS VARCHAR) AS leaf FROM nation UNION ALL SELECT n_nationkey, 'geo.name', '\"x\"' FROM nation UNION ALL SELECT n_nationkey, 'runs.last', '3' FROM nation")
def n4_vars_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(_nation_vars(spark, sf_dir).withColumn("v", tree.set_values(F.col("v"), {"geo": {"name": "x"}, "runs.last": 3})))


@query("SELECT n_nationkey, 'geo' AS path, '42' AS leaf FROM nation UNION ALL SELECT n_nationkey, 'runs', CAST(n_nationkey AS VARCHAR) FROM nation")
def n5_vars_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(_nation_vars(spark, sf_dir).withColumn("v", tree.merged(F.col("v"), F.create_map(F.lit("geo"), F.lit("42")))))


@query("SELECT n_nationkey, CAST(n_nationkey + 2.5 AS DOUBLE) AS runs, CAST(1 AS DOUBLE) AS fresh FROM nation")
def n6_vars_incr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _nation_vars(spark, sf_dir).withColumn("v", tree.increment(F.col("v"), "runs", 2.5)).withColumn("v", tree.increment(F.col("v"), "new.count", 1))
    return out.select("n_nationkey", F.element_at("v", F.lit("runs")).cast("double").alias("runs"), F.element_at("v", F.lit("new.count")).cast("double").alias("fresh"))


@query("SELECT n_nationkey, 'runs' AS path, CAST(n_nationkey AS VARCHAR) AS leaf FROM nation")
def n7_vars_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(_nation_vars(spark, sf_dir).withColumn("v", tree.unset(F.col("v"), "geo")))


_TOKENS = "SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS token FROM documents"
_ENTROPY = """
t AS (SELECT token FROM w WHERE length(token) >= 20),
c AS (SELECT token, ch, CAST(count(*) AS DOUBLE) / length(token) AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM t) WHERE ch <> '' GROUP BY token, ch),
e AS (SELECT token, -sum(p * log2(p)) AS h FROM c GROUP BY token)"""


def _long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = scan(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("token"))
    return words.where(F.length("token") >= 20).distinct()


@query(f"WITH w AS ({_TOKENS}), {_ENTROPY} SELECT token, round(h, 6) AS entropy FROM e")
def f2_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_tokens(spark, sf_dir).select("token", F.round(fn.entropy("token"), 6).alias("entropy"))


@query(f"WITH w AS ({_TOKENS}), {_ENTROPY} SELECT token, (round(h, 6) >= 3.2 OR regexp_matches(token, '^[A-Za-z0-9+/_-]{{24,}}={{0,2}}$')) AS sensitive FROM e")
def f4_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_tokens(spark, sf_dir).select("token", fn.is_sensitive("token").alias("sensitive"))


@query("SELECT event_id, CAST(least(60000, greatest(250, pow(2, event_id % 14) * 100)) AS BIGINT) AS delay_ms FROM events")
def f8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").select("event_id", fn.backoff_ms(F.col("event_id") % 14).alias("delay_ms"))


@query("SELECT event_id, CAST(floor((epoch_us(ts) // 1000) / 86400000.0) AS BIGINT) AS bucket FROM events")
def f10_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ms(spark, sf_dir).select("event_id", fn.time_bucket(F.col("ts_ms"), 86400).alias("bucket"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts, event_id LIMIT 200")
def o2_due_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_ms(spark, sf_dir).withColumn("state", F.lit("pending")).withColumn("next_attempt_at_ms", F.col("ts_ms"))
    return reliability.due(rows, 2**60, 200, ["ts", "event_id"]).select("event_id", "event_type", "user_id")


_LAST = f"SELECT user_id, max((epoch_us(ts) // 1000)) AS last_ms, greatest(0, {NOW_MS} - max((epoch_us(ts) // 1000))) AS idle FROM events GROUP BY 1"


@query(f"SELECT user_id, last_ms, CASE WHEN idle >= 3600000 THEN 'dead' WHEN idle >= 300000 THEN 'suspected' ELSE 'alive' END AS state FROM ({_LAST})")
def t8_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events.high_water(_event_ms(spark, sf_dir), ["user_id"], ["ts_ms"]).withColumnRenamed("ts_ms", "last_ms")
    return last.withColumn("state", reliability.liveness(F.col("last_ms"), NOW_MS))


@query(f"SELECT user_id, (user_id % 5 = 0 OR idle >= 8000) AS may_start FROM ({_LAST})")
def t9_discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events.high_water(_event_ms(spark, sf_dir), ["user_id"], ["ts_ms"])
    state = F.when(F.col("user_id") % 5 == 0, "deferred").otherwise("queued")
    return last.select("user_id", reliability.may_start(F.col("ts_ms"), state, NOW_MS).alias("may_start"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def m2_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", columns=["user_id", "ts", "event_id", "event_type"]).withColumn("at", F.struct("ts", "event_id"))
    return events.last_wins(rows, ["user_id"], "at", ["event_type"]).select("user_id", F.col("at.ts").alias("ts"), "event_type", F.col("at.event_id").alias("event_id"))


@query("SELECT n.o_orderkey AS node_id, n.o_custkey AS task_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE o.o_custkey = n.o_custkey AND l_returnflag = 'R' AND l_quantity >= 49) AND n.o_orderstatus <> 'F' THEN 'cancelling' ELSE CASE n.o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' ELSE 'queued' END END AS new_status FROM orders n")
def m14_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("task_id"), F.expr(_STATUS).alias("status"))
    failed = scan(spark, sf_dir, "lineitem", "l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_orderkey").alias("node_id")).distinct()
    return graph.cancel(orders, orders.join(failed, "node_id", "left_semi"), "task_id").select("node_id", "task_id", "new_status")


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'sent' WHEN event_id % 14 + 1 >= 12 THEN 'failed' ELSE 'retry' END AS state, CAST(CASE WHEN event_type = 'view' THEN event_id % 14 ELSE event_id % 14 + 1 END AS BIGINT) AS attempts, CASE WHEN event_type <> 'view' AND event_id % 14 + 1 < 12 THEN {NOW_MS} + CAST(least(60000, greatest(250, pow(2, event_id % 14 + 1) * 100)) AS BIGINT) END AS next_ms FROM events")
def r1_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 14).alias("attempts"))
    out = reliability.after_attempt(rows, F.col("event_type") == "view", NOW_MS)
    return out.select("event_id", F.col("new_state").alias("state"), F.col("new_attempts").alias("attempts"), F.col("new_next_attempt_at_ms").alias("next_ms"))


@query("SELECT sha256(CAST(to_json([event_type, CAST(user_id AS VARCHAR), CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)]) AS VARCHAR)) AS fp, min(event_id) AS event_id FROM events GROUP BY 1")
def r2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.floor("value").cast("long").cast("string").alias("dedup_id"))
    return reliability.enqueued(rows, ["event_id"]).select("fp", "event_id")


@query(f"SELECT event_id, user_id FROM events WHERE (epoch_us(ts) // 1000) > {NOW_MS} - 14 * 86400000")
def k12_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.retained(_event_ms(spark, sf_dir), F.col("ts_ms"), NOW_MS, 14).select("event_id", "user_id")


@query("SELECT l_orderkey AS node_id, l_linenumber AS batch_uid, arg_min(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS first_worker, arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def k1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.struct(*_ORDER)
    rows = scan(spark, sf_dir, "lineitem").select(F.lit("t").alias("task_id"), F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("batch_uid"), F.col("l_suppkey").alias("worker_id"), F.col("l_returnflag").alias("status"), F.lit(1).alias("meta"), seq.alias("seq"))
    return artifacts.upserted(rows).select("node_id", "batch_uid", F.col("worker_id").alias("first_worker"), "status", F.col("writes").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events")
def t7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events and all of them again, as a stream, once each. The result is a written table."""
    from ..sources.scratch import scratch_folder

    place = scratch_folder(spark, f"stream-{uuid.uuid4().hex}")
    rows = scan(spark, sf_dir, "events", columns=["event_id", "user_id", "event_type", "ts"])
    rows.union(rows).write.parquet(f"{place}/in")
    stream = status.read_events(spark, f"{place}/in", rows.schema)
    status.drain(status.first_wins_stream(stream, ["event_id"], delay="1 day"), f"{place}/checkpoint", f"{place}/out")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{place}/out")


class CountWords(Handler):
    """Counts words and characters of a text; an empty payload is an error."""

    def process_batch(self, batch) -> BatchResult:
        if not batch.payload:
            raise ValueError("empty payload")
        return BatchResult(True, {"words": len(batch.payload.split(" ")), "chars": len(batch.payload)})


@query("SELECT conv_id, turn, text <> '' AS success, CAST(CASE WHEN text <> '' THEN len(string_split(text, ' ')) END AS BIGINT) AS words, CAST(CASE WHEN text <> '' THEN length(text) END AS BIGINT) AS chars FROM conversations")
def x1_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"), F.concat_ws("-", "conv_id", "turn").alias("batch_uid"), F.col("text").alias("payload"))
    number = lambda k: F.element_at("metrics", F.lit(k)).cast("long").alias(k)
    turn: Column = F.split_part("batch_uid", F.lit("-"), F.lit(2)).cast("long").alias("turn")
    return run_batches(rows, CountWords).select(F.col("task_id").cast("long").alias("conv_id"), turn, "success", number("words"), number("chars"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, (epoch_us(ts) // 1000) AS ms FROM events),
d AS (SELECT user_id, min((ms, event_id)) AS stop FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT CAST(e.user_id AS VARCHAR) AS task_id, CASE WHEN any_value(stop) IS NULL THEN 'running' ELSE 'finished' END AS status,
 CAST(count(*) FILTER (WHERE event_type = 'purchase' AND (stop IS NULL OR (ms, event_id) < stop)) AS BIGINT) AS batches_ok
FROM e LEFT JOIN d USING (user_id) GROUP BY 1""")
def m3_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are batches, an error ends a run: batches after it are dropped."""
    rows = _event_ms(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "BATCH_OK").when(F.col("event_type") == "error", "TASK_DONE").otherwise("TASK_HEARTBEAT")
    given = rows.select(F.col("user_id").cast("string").alias("task_id"), F.lit("n").alias("node_id"), kind.alias("kind"), F.lit(1).alias("epoch"), F.col("ts_ms").alias("recv_ts_ms"), F.col("event_id").alias("seq"), F.lit("w").alias("worker_id"), (F.col("ts_ms") + 60_000).alias("deadline_ms"), F.col("event_id").cast("string").alias("batch_uid"), F.lit(False).alias("permanent"))
    first = given.groupBy("task_id", "node_id").agg(F.lit("TASK_START").alias("kind"), F.lit(1).alias("epoch"), (F.min("recv_ts_ms") - 1).alias("recv_ts_ms"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("long").alias("deadline_ms"), F.lit(None).cast("string").alias("batch_uid"), F.lit(False).alias("permanent"))
    return events.fold_state(given.unionByName(first)).select("task_id", "status", "batches_ok")
