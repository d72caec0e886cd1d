"""Functions of the coordinator by name, and pluggable detectors of sensitive values.

A function takes the tables (a dict of DataFrames: vars, artifacts, metrics, nodes), the task's id and arguments, and
returns the tables with its changes. vars has the columns task_id and v, the flat map of operators.vars.
"""

from __future__ import annotations

import importlib
import inspect
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ANY_CASE, SECRET_MIN_CHARS, SECRET_MIN_ENTROPY, SECRET_PATTERNS
from . import artifacts as arts
from . import metrics
from . import vars as tree

Tables = dict[str, DataFrame]


class FunctionError(ValueError):
    """Arguments that a function can't work with, or a name that is not registered."""


def _change(tables: Tables, task_id: str, change: Callable[[Column], Column]) -> Tables:
    v = tables["vars"]
    return tables | {"vars": v.withColumn("v", F.when(F.col("task_id") == F.lit(task_id), change(F.col("v"))).otherwise(F.col("v")))}


def _detector(args: dict[str, Any], detector: Any) -> Callable[[str, Any], bool] | None:
    """Sensitive values are an error only where the caller asks for it."""
    return as_detector(detector) if args.pop("block_sensitive", False) else None


def vars_set(tables: Tables, task_id: str, detector: Any = None, **kv: Any) -> Tables:
    data = dict(kv["kv"]) if isinstance(kv.get("kv"), Mapping) else dict(kv)
    if isinstance(kv.get("kv"), Mapping) and kv.get("block_sensitive"):
        data["block_sensitive"] = True
    judge = _detector(data, detector)
    return _change(tables, task_id, lambda v: tree.set_values(v, data, judge))


def vars_merge(tables: Tables, task_id: str, detector: Any = None, **kv: Any) -> Tables:
    data = kv.get("data", kv.get("kv", kv))
    if not isinstance(data, Mapping):
        raise FunctionError("vars.merge needs a mapping")
    judge = _detector({"block_sensitive": kv.get("block_sensitive")}, detector)
    flat = tree.flatten({k: v for k, v in data.items() if not (data is kv and k == "block_sensitive")})
    return _change(tables, task_id, lambda v: tree.set_values(v, flat, judge))


def vars_incr(tables: Tables, task_id: str, key: str = "", by: float = 1, **_: Any) -> Tables:
    return _change(tables, task_id, lambda v: tree.increment(v, key, by))


def vars_unset(tables: Tables, task_id: str, *paths: str, keys: list[str] | None = None, **_: Any) -> Tables:
    return _change(tables, task_id, lambda v: tree.unset(v, *paths, *(keys or [])))


def merge_generic(tables: Tables, task_id: str, from_nodes: list[str] | None = None, target: Mapping[str, Any] | None = None, **_: Any) -> Tables:
    """Summary of the sources' artifacts, as the complete artifact of the target node."""
    if not isinstance(target, Mapping) or not target:
        raise FunctionError("merge.generic needs a target")
    rows = tables["artifacts"].where(F.col("task_id") == F.lit(task_id))
    meta = arts.merge_meta(rows, from_nodes or [])
    text = F.to_json(F.struct(F.lit(from_nodes or []).alias("merged_from"), "complete_nodes", "partial_batches", "distinct_batch_uids"))
    node = target.get("node_id") or "coordinator"
    values = {"node_id": F.lit(node), "status": F.lit("complete"), "batch_uid": F.lit(None), "meta": text}
    have = dict(tables["artifacts"].dtypes)
    made = meta.select(*[(values[c] if c in values else F.col("task_id") if c == "task_id" else F.lit(None)).cast(t).alias(c) for c, t in have.items()])
    same = (F.col("task_id") == F.lit(task_id)) & (F.col("node_id") == F.lit(node)) & F.col("batch_uid").isNull()
    return tables | {"artifacts": tables["artifacts"].where(~F.coalesce(same, F.lit(False))).union(made)}


def metrics_aggregate(tables: Tables, task_id: str, node_id: str = "", mode: str = "sum", **_: Any) -> Tables:
    """The node's statistics, written to it."""
    rows = tables["metrics"].where((F.col("task_id") == F.lit(task_id)) & (F.col("node_id") == F.lit(node_id)))
    stats = metrics.as_maps(metrics.aggregate(rows, mode)).withColumnRenamed("stats", "_new")
    nodes = tables["nodes"].join(stats, ["task_id", "node_id"], "left")
    return tables | {"nodes": nodes.withColumn("stats", F.coalesce("_new", "stats")).drop("_new")}


def noop(tables: Tables, task_id: str, **_: Any) -> Tables:
    return tables


# Names of the functions.
FUNCTIONS: dict[str, Callable[..., Tables]] = {
    "vars.set": vars_set,
    "vars.merge": vars_merge,
    "vars.incr": vars_incr,
    "vars.unset": vars_unset,
    "merge.generic": merge_generic,
    "metrics.aggregate": metrics_aggregate,
    "noop": noop,
}


def call(tables: Tables, task_id: str, name: str | None, args: Mapping[str, Any] | None = None, registry: Mapping[str, Callable[..., Tables]] | None = None) -> Tables:
    """Run a function by name; a registry that is given replaces the built-in one as a whole."""
    known = FUNCTIONS if registry is None else registry
    if (name or "noop") not in known:
        raise FunctionError(f"function {name!r} is not registered")
    return known[name or "noop"](tables, task_id, **dict(args or {}))


class DefaultDetector:
    """The default judgement of functions.scalars.is_sensitive, for values on the driver."""

    def is_sensitive(self, path: str, value: Any) -> bool:
        if isinstance(value, (bytes, bytearray)):
            if len(value) >= SECRET_MIN_CHARS:
                return True
            value = bytes(value).decode("utf-8", "ignore")
        if not isinstance(value, str) or len(value.strip()) < SECRET_MIN_CHARS:
            return False
        text = value.strip()
        if any(re.match(p, text, re.IGNORECASE if p == ANY_CASE else 0) for p in SECRET_PATTERNS):
            return True
        return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) >= SECRET_MIN_ENTROPY


def as_detector(given: Any = None) -> Callable[[str, Any], bool]:
    """A predicate (path, value) from an object with is_sensitive, a predicate, a factory of either, or an import string."""
    if given is None:
        given = DefaultDetector()
    if isinstance(given, str):
        module, _, name = given.partition(":") if ":" in given else given.rpartition(".")
        if not module or not name:
            raise FunctionError(f"bad import string {given!r}")
        given = getattr(importlib.import_module(module), name)
    if hasattr(given, "is_sensitive") and not inspect.isclass(given):
        return lambda path, value: bool(given.is_sensitive(path, value))
    if not callable(given):
        raise FunctionError("a detector is callable or has is_sensitive()")
    kinds = [p.kind for p in inspect.signature(given).parameters.values()]
    positional = kinds.count(inspect.Parameter.POSITIONAL_ONLY) + kinds.count(inspect.Parameter.POSITIONAL_OR_KEYWORD)
    if inspect.Parameter.VAR_POSITIONAL in kinds or positional >= 2:
        return lambda path, value: bool(given(path, value))
    return as_detector(given())


def sensitive_udf(given: Any = None) -> Callable[..., Column]:
    """A detector as a column function (path, value), in Arrow batches; the default one has a native form in scalars."""
    judge = as_detector(given)

    @F.pandas_udf("boolean")
    def judged(path, value):
        import pandas as pd

        return pd.Series([judge(p, v) for p, v in zip(path, value, strict=True)], dtype=bool)

    return judged
