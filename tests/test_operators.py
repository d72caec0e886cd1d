import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts, events, graph, metrics, reliability
from tessera.operators import vars as tree

METRICS = "task_id string, node_id string, batch_uid string, failed boolean, metrics map<string,string>, seq int"


def metric_rows(spark, total, size, task="t", node="n", copies=1, seed=0):
    """total items in batches of size; each row written several times, later copies with other values."""
    rows = []
    for k in range(-(-total // size)):
        for c in range(copies):
            rows.append((task, node, f"b{k}", False if c % 2 else None, {"count": str(min(size, total - k * size) + c), "tags": "[1]", "who": "x"}, k + 1000 * c))
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, METRICS)


def total(rows, **kw):
    return {(r.task_id, r.node_id, r.key): r.value for r in metrics.aggregate(metrics.recorded(rows, ["seq"]), **kw).collect()}


@pytest.mark.parametrize("items, size, copies", [(13, 5, 1), (10, 3, 1), (18, 6, 2), (12, 4, 3)])
def test_sums_are_exact_under_repetition_and_disorder(spark, items, size, copies):
    for seed in range(2):
        assert total(metric_rows(spark, items, size, copies=copies, seed=seed)) == {("t", "n", "count"): items}


def test_sums_over_sources_and_tasks(spark):
    three = metric_rows(spark, 6, 5, node="a").union(metric_rows(spark, 7, 5, node="b")).union(metric_rows(spark, 9, 5, node="c"))
    assert sum(total(three).values()) == 22
    two = metric_rows(spark, 7, 3, task="x").union(metric_rows(spark, 11, 3, task="y"))
    assert total(two) == {("x", "n", "count"): 7, ("y", "n", "count"): 11}


def test_failed_rows_final_rows_and_means(spark):
    rows = spark.createDataFrame([("t", "n", "1", True, {}, 1), ("t", "n", "1", False, {"k": "5"}, 2), ("t", "n", "2", None, {"k": "3", "j": "1"}, 3), ("t", "n", "__final__", False, {"k": "1"}, 4)], METRICS)
    assert total(rows) == {("t", "n", "k"): 4, ("t", "n", "j"): 1}
    assert total(rows, mode="mean") == {("t", "n", "k"): 2, ("t", "n", "j"): 1}
    assert total(rows, mode="anything") == total(rows)
    retried = metrics.aggregate(metrics.recorded(rows, ["seq"], on_retry="latest_success"))
    assert {r.key: r.value for r in retried.collect()} == {"k": 9, "j": 1}
    assert metrics.as_maps(metrics.aggregate(rows)).first().stats["j"] == 1


def test_rechunk_golden_sizes(spark):
    def sizes(lists, size, **kw):
        rows = spark.createDataFrame([(f"b{i}", x) for i, x in enumerate(lists)], "batch_uid string, items array<int>")
        out = artifacts.rechunk(rows, "items", size, F.lit("src"), F.col("batch_uid"))
        return [len(r.chunk) for r in out.orderBy("batch_uid", "chunk_no").collect()], out

    assert sizes([[1, 2, 3, 4]], 2)[0] == [2, 2]
    assert sizes([[1, 2, 3], [4, 5, 6]], 2)[0] == [2, 1, 2, 1]
    assert sizes([[], [1]], 3)[0] == [1]
    assert sizes([[1, 2]], 0)[0] == [1, 1]
    assert sizes([list(range(11))], 4)[0] == [4, 4, 3]
    uids = [r.chunk_uid for r in sizes([list(range(9))], 4)[1].collect()]
    assert len(set(uids)) == 3 and uids == [r.chunk_uid for r in sizes([list(range(9))], 4)[1].collect()]


def test_upsert_keeps_first_and_last(spark):
    rows = spark.createDataFrame([("t", "n", "a", "partial", "m1", "w1", 1), ("t", "n", "a", "failed", "m2", "w2", 2), ("t", "n", None, "complete", "m3", "w3", 3), ("t", "n", None, "complete", "m4", "w4", 4)], "task_id string, node_id string, batch_uid string, status string, meta string, worker_id string, seq int")
    got = {r.batch_uid: (r.worker_id, r.status, r.meta, r.created_seq, r.updated_seq) for r in artifacts.upserted(rows).collect()}
    assert got == {"a": ("w1", "failed", "m2", 1, 2), None: ("w3", "complete", "m4", 3, 4)}
    with pytest.raises(ValueError):
        artifacts.checked_uid("")


def test_merge_pull_and_end_of_stream(spark):
    rows = spark.createDataFrame([("t", "a", "1", "partial"), ("t", "a", None, "complete"), ("t", "b", "1", "partial"), ("t", "b", "2", "failed"), ("t", "b", "", "partial"), ("t", "z", "9", "partial")], "task_id string, node_id string, batch_uid string, status string")
    m = artifacts.merge_meta(rows, ["a", "b"]).first()
    assert (m.complete_nodes, m.partial_batches, m.distinct_batch_uids) == (["a"], 3, 1)
    many = spark.range(450).select(F.lit("t").alias("task_id"), F.lit("a").alias("node_id"), F.col("id").cast("string").alias("batch_uid"), F.lit("partial").alias("status"))
    claims = many.where("id % 3 = 0") if "id" in many.columns else many.where(F.col("batch_uid").cast("int") % 3 == 0)
    assert artifacts.pull(many, ["a"], claims.select("batch_uid"), ["batch_uid"]).count() == 300
    assert not artifacts.upstream_complete(rows, ["a", "b"]).first().complete
    assert artifacts.upstream_complete(rows, ["a"]).first().complete


def nodes_of(spark, *nodes, edges=()):
    return graph.to_tables(spark, "t", {"nodes": list(nodes), "edges": list(edges)})[0]


def test_readiness_rules(spark):
    base = [{"node_id": "f", "status": "finished"}, {"node_id": "r", "status": "running"}]
    dep = lambda i, fan, deps, **kw: {"node_id": i, "fan_in": fan, "depends_on": deps, **kw}
    nodes = nodes_of(
        spark, *base, dep("all", "all", ["f", "r"]), dep("any", "ANY", ["f", "r"]), dep("two", "count:2", ["f", "r"]), dep("one", "count:1", ["f", "r"]), dep("bad", "count:x", ["f"]),
        dep("none_all", "all", []), dep("none_any", "any", []), dep("odd", "most", ["f"]), dep("ghost", "all", ["missing"]), dep("first", "all", ["r"], io={"start_when": "first_batch"}),
        dep("late", "all", ["f"], status="deferred", next_retry_ms=900), dep("due", "all", ["f"], status="deferred", next_retry_ms=100),
    )
    arts = spark.createDataFrame([("t", "r", "partial")], "task_id string, node_id string, status string")
    got = {r.node_id for r in graph.ready(nodes, arts, 500).collect()}
    assert got == {"any", "one", "bad", "none_all", "first", "due"}
    started = {r.node_id: (r.status, r.attempt_epoch) for r in graph.start(nodes, graph.ready(nodes, arts, 500)).collect()}
    assert started["any"] == ("running", 1) and started["all"] == ("queued", 0) and started["f"] == ("finished", 0)
    with pytest.raises(ValueError):
        nodes_of(spark, {"node_id": "a"}, {"node_id": "a"})


def test_children_finalisation_cancel_and_adoption(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "src string, dst string")
    extended = spark.createDataFrame([("a", "d", "async", "on_batch"), ("a", "e", "sync", "on_batch"), ("a", "c", "async", "on_batch")], "src string, dst string, mode string, trigger string")
    assert {(r.src, r.dst) for r in graph.children(edges, extended).collect()} == {("a", x) for x in "bcde"}
    assert {r.dst for r in graph.starts_on_batch(extended).collect()} == {"c", "d"}
    n = spark.createDataFrame([("x", "finished", False), ("x", "finished", False), ("y", "finished", False), ("y", "failed", False), ("z", "deferred", True), ("z", "finished", True)], "task_id string, status string, cancelled boolean")
    assert {r.task_id: r.finished for r in graph.finalized(n, ["task_id"], F.col("cancelled")).collect()} == {"x": True, "y": False, "z": True}
    hit = graph.cancel(n, spark.createDataFrame([("z",)], "task_id string"), "task_id").where("task_id = 'z'").collect()
    assert sorted(r.new_status for r in hit) == ["cancelling", "finished"]
    node = spark.createDataFrame([("t", "n", 2, "w1"), ("t", "m", 2, None)], "task_id string, node_id string, attempt_epoch int, lease_worker string")
    snap = spark.createDataFrame([("t", "n", 2, "w1", "running"), ("t", "n", 1, "w1", "running"), ("t", "m", 2, "w2", "running")], "task_id string, node_id string, attempt_epoch int, worker_id string, run_state string")
    assert [r.node_id for r in graph.adoptable(node, snap).collect()] == ["n"]


def test_fold_gates_fences_and_deduplicates(spark):
    row = lambda node, kind, seq, epoch=1, uid=None, perm=False, deadline=None: ("t", node, kind, epoch, 1000 + seq, seq, "w", deadline, uid, perm)
    log = [
        row("a", "TASK_START", 0), row("a", "TASK_ACCEPTED", 1, deadline=50), row("a", "TASK_HEARTBEAT", 2, deadline=90), row("a", "TASK_HEARTBEAT", 3, deadline=70),
        row("a", "BATCH_OK", 4, uid="1"), row("a", "BATCH_OK", 5, uid="1"), row("a", "BATCH_OK", 6, epoch=0, uid="9"), row("a", "TASK_DONE", 7), row("a", "BATCH_OK", 8, uid="2"),
        row("b", "TASK_START", 0), row("b", "TASK_FAILED", 1), row("b", "TASK_START", 2, epoch=2), row("b", "BATCH_FAILED", 3, epoch=2, uid="1"), row("b", "TASK_FAILED", 4, epoch=2, perm=True),
        row("c", "BATCH_OK", 1, uid="1"),
    ]
    random.Random(2).shuffle(log)
    df = spark.createDataFrame(log, "task_id string, node_id string, kind string, epoch int, recv_ts_ms long, seq long, worker_id string, deadline_ms long, batch_uid string, permanent boolean")
    got = {r.node_id: r for r in events.fold_state(df).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.status, a.epoch, a.batches_ok, a.lease_deadline_ms, a.last_event_ms) == ("finished", 1, 1, 90, 1007)
    assert (b.status, b.epoch, b.batches_failed, b.task_failed) == ("cancelling", 2, 1, True)
    assert (c.status, c.batches_ok) == ("queued", 0)


def test_event_tables(spark):
    rows = spark.createDataFrame([("k", 0, "a"), ("k", 5, "b"), ("k", 10, "c"), ("k", 11, "d"), ("j", 3, "e")], "key string, ms long, tag string")
    assert {r.tag for r in events.within_ttl_dedup(rows, ["key"], "ms", 10, "tag").collect()} == {"a", "d", "e"}
    assert {r.tag for r in events.first_wins(rows, ["key"], ["ms"]).collect()} == {"a", "e"}
    assert {r.key: r.tag for r in events.last_wins(rows, ["key"], "ms", ["tag"]).collect()} == {"k": "d", "j": "e"}
    assert events.retained(rows, F.col("ms"), 86_400_010, 1).count() == 1
    nodes = spark.createDataFrame([("k", 5)], "key string, ms long")
    assert [r.tag for r in events.fence(rows, nodes, ["key"], "ms").collect()] == ["b"]
    assert rows.where(events.not_value("tag", "a")).count() == 4


def test_variables(spark):
    start = F.create_map(F.lit("obj.a"), F.lit("1"), F.lit("obj.b.c"), F.lit("2"), F.lit("n"), F.lit("0"))
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(tree.set_values(start, {"obj": {"a": 9, "d": {"e": [1]}}, "x.y": {"z": 1}})) == {"obj.a": "9", "obj.b.c": "2", "n": "0", "obj.d.e": "[1]", "x.y": '{"z":1}'}
    assert one(tree.set_values(start, {"obj": 42})) == {"obj": "42", "n": "0"}
    assert one(tree.merged(F.create_map(F.lit("obj"), F.lit("42")), F.create_map(F.lit("obj.a"), F.lit("1")))) == {"obj.a": "1"}
    assert one(tree.unset(start, "obj.b", "missing")) == {"obj.a": "1", "n": "0"}
    value = start
    for by in [1] * 10 + [2] * 5:
        value = tree.increment(value, "n", by)
    assert float(one(value)["n"]) == 20
    began = time.perf_counter()
    assert float(one(tree.increments(start, [("n", 1), ("new.count", 0.5)] * 500))["new.count"]) == 250
    assert time.perf_counter() - began < 30
    deep = start
    for k in range(12):
        deep = tree.merged(deep, F.create_map(F.lit(f"obj.b.k{k}"), F.lit(str(k))))
    assert set(one(deep)) == {"obj.a", "obj.b.c", "n", *(f"obj.b.k{k}" for k in range(12))}
    assert one(tree.subtree(start, "obj.b")) == {"c": "2"} and one(tree.subtree(start, "n")) == {"": "0"} and one(tree.subtree(start, "ob")) == {}
    assert tree.touched("obj.b", "missing", "missing") == 2
    assert float(one(tree.increment(tree.increment(start, "f", 1.5), "f", -0.5))["f"]) == 1.0
    with pytest.raises(Exception, match="not a number"):
        one(tree.increment(F.create_map(F.lit("n"), F.lit('"text"')), "n", 1))


@pytest.mark.parametrize("path", ["", "$bad", "a..b", "a\x00b", "x" * 129, ".".join("a" * 20), "a." * 300 + "b"])
def test_bad_paths(path):
    with pytest.raises(tree.VarsError):
        tree.check_path(path)


def test_variable_limits_and_detector():
    for by in (True, float("nan"), float("inf"), "1", None):
        with pytest.raises(tree.VarsError):
            tree.checked_step(by)
    with pytest.raises(tree.VarsError):
        tree.assignments({f"k{i}": 1 for i in range(257)})
    with pytest.raises(tree.VarsError):
        tree.check_value("é" * 40_000)
    with pytest.raises(tree.VarsError):
        tree.assignments({"a": {"token": "s"}}, detector=lambda path, _: path.endswith("token"))
    assert tree.flatten({"a": {"b": {}, "c": 1}, "d": [{}]}) == {"a.c": 1, "d": [{}]}


def test_outbox_and_liveness(spark):
    rows = spark.createDataFrame([("t", "k", "d1", "pending", 0, 5, 1), ("t", "k", "d1", "pending", 0, 6, 2), ("t", "k", "d2", "retry", 11, 9, 3), ("t", "k", "d3", "sent", 1, 1, 4)], "topic string, key string, dedup_id string, state string, attempts int, next_attempt_at_ms long, seq int")
    box = reliability.enqueued(rows, ["seq"])
    assert sorted(r.seq for r in box.collect()) == [1, 3, 4]
    assert [r.seq for r in reliability.due(box, 9, 200, ["next_attempt_at_ms"]).collect()] == [1, 3]
    after = {r.seq: (r.new_state, r.new_attempts, r.new_next_attempt_at_ms) for r in reliability.after_attempt(box, F.col("seq") == 1, 1000).collect()}
    assert after == {1: ("sent", 0, None), 3: ("failed", 12, None), 4: ("retry", 2, 1400)}
    idle = spark.createDataFrame([(0,), (299_999,), (300_000,), (3_600_000,), (-5,)], "i long")
    assert [r.s for r in idle.select(reliability.liveness(F.lit(10_000_000) - F.col("i"), 10_000_000).alias("s")).collect()] == ["alive", "alive", "suspected", "dead", "alive"]
    gate = spark.createDataFrame([(9_000, "queued"), (1_000, "queued"), (9_000, "deferred"), (None, "queued")], "last long, s string")
    assert [r.g for r in gate.select(reliability.may_start(F.col("last"), F.col("s"), 10_000).alias("g")).collect()] == [False, True, True, True]
