"""User code: the handler protocol, input adapters, argument checks, and the runner that applies a handler to batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..operators.artifacts import pull, rechunk


@dataclass
class Batch:
    payload: Any
    batch_uid: str | None = None


@dataclass
class BatchResult:
    success: bool
    metrics: dict[str, Any] = field(default_factory=dict)
    reason_code: str | None = None
    permanent: bool = False
    error: str | None = None
    partials: list[dict[str, Any]] = field(default_factory=list)


class Handler:
    """Subclass and override. init, load_input, iter_batches, process_batch for each batch, finalize."""

    def init(self, config: dict) -> None:
        """Once, before the first batch of a task."""

    def load_input(self, input_ref: dict | None, input_inline: dict | None) -> dict:
        return {"input_ref": input_ref or {}, "input_inline": input_inline or {}}

    def iter_batches(self, loaded: Any) -> Iterable[Batch]:
        yield Batch(loaded)

    def process_batch(self, batch: Batch) -> BatchResult:
        return BatchResult(True)

    def finalize(self) -> dict[str, Any]:
        return {}

    def classify_error(self, error: Exception) -> tuple[str, bool]:
        """(reason, permanent): wrong types, values and keys will be wrong again; everything else may pass."""
        return "unexpected_error", isinstance(error, (TypeError, ValueError, KeyError))


class EchoHandler(Handler):
    """Sample: five steps for each batch, and a partial artifact after the third and the fifth if the batch has a uid."""

    STEPS = 5

    def process_batch(self, batch: Batch) -> BatchResult:
        marks = [{"echoed": i} for i in range(self.STEPS) if i and i % 2 == 0]
        return BatchResult(True, {"echoed": self.STEPS}, partials=marks if batch.batch_uid else [])


class AdapterError(Exception):
    """Input adapter that can't be used; permanent."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason, self.permanent = reason, True


def _rechunked(artifacts: DataFrame, from_nodes: list[str], size: int, meta_list_key: str | None = None) -> DataFrame:
    """Artifacts with meta map<string,array<string>>: chunks of the named list, or of each whole row as one item."""
    whole = F.array(F.to_json("meta"))
    items = whole if meta_list_key is None else F.coalesce(F.element_at("meta", F.lit(meta_list_key)), whole)
    return rechunk(pull(artifacts, from_nodes), items, size, F.col("node_id"), F.col("batch_uid"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"pull.from_artifacts": pull, "pull.from_artifacts.rechunk:size": _rechunked}


def check_arguments(name: str, args: dict[str, Any], strict: bool = False) -> dict[str, Any]:
    """Normalised arguments: from_node stands for from_nodes; sizes are positive whole numbers and no booleans."""
    out = dict(args)
    if "from_node" in out and "from_nodes" not in out:
        out["from_nodes"] = [out["from_node"]]
    out.pop("from_node", None)
    nodes = out.get("from_nodes")
    if not isinstance(nodes, list) or not nodes or not all(isinstance(n, str) and n for n in nodes):
        raise AdapterError("bad_input_args", "from_nodes must name nodes")
    if name.endswith("rechunk:size"):
        size = out.get("size")
        if isinstance(size, bool) or not isinstance(size, int) or size < 1:
            raise AdapterError("bad_input_args", "size must be a positive whole number")
        key = out.get("meta_list_key")
        if key is not None and not isinstance(key, str) or strict and not key:
            raise AdapterError("bad_input_args", "meta_list_key must be a text")
    return out


def resolve_adapter(command: str | None, from_handler: str | None, registry: dict[str, Callable] | None = None) -> str | None:
    """The command's adapter, else the handler's if it is known, else none (the handler makes its own batches)."""
    known = ADAPTERS if registry is None else registry
    if command:
        if command not in known:
            raise AdapterError("bad_input_adapter", f"unknown adapter {command!r}")
        return command
    return from_handler if from_handler in known else None


RESULTS = "task_id string, batch_uid string, success boolean, metrics map<string,string>, reason string, permanent boolean"


def input_arguments(input_ref: dict | None, input_inline: dict | None, loaded: dict | None = None) -> tuple[str | None, dict[str, Any]]:
    """Adapter and arguments of a run. What a handler loads may add arguments, but not replace the coordinator's adapter.

    A handler's own adapter counts only where the command names none and the adapter is known.
    """
    inline, own = input_inline or {}, (loaded or {}).get("input_inline") or {}
    adapter = resolve_adapter(inline.get("input_adapter"), own.get("input_adapter"))
    return adapter, {**(own.get("input_args") or {}), **(inline.get("input_args") or {})}


def pulled(artifacts: DataFrame, input_inline: dict, strict: bool = False) -> DataFrame:
    """The batches of a command's adapter, its arguments checked."""
    adapter, args = input_arguments(None, input_inline)
    if adapter is None:
        raise AdapterError("bad_input_adapter", "no adapter is named")
    return ADAPTERS[adapter](artifacts, **check_arguments(adapter, args, strict))


def _handled(h: Handler, batch: Batch) -> BatchResult:
    try:
        return h.process_batch(batch)
    except Exception as e:  # user code
        reason, permanent = h.classify_error(e)
        return BatchResult(False, {}, reason, permanent, str(e))


def _texts(metrics: dict[str, Any]) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in metrics.items()}


EVENTS = "task_id string, seq long, kind string, batch_uid string, metrics map<string,string>, reason string, permanent boolean"


def run_tasks(tasks: DataFrame, handler: type[Handler], config: dict | None = None) -> DataFrame:
    """tasks (task_id, input_inline as JSON) through the whole protocol, a task in one call: its events in order.

    init, load_input, iter_batches and process_batch for each batch; at the first failed batch BATCH_FAILED and
    TASK_FAILED and no more, else finalize and TASK_DONE with its metrics. Events go out as the batches are handled,
    so a task's memory is that of one batch.
    """
    from pyspark.sql import types as T

    columns = T._parse_datatype_string(EVENTS).names

    def events(task: str, inline: str | None) -> Iterator[tuple]:
        h, seq = handler(), 0
        try:
            h.init(config or {})
            batches = iter(h.iter_batches(h.load_input(None, json.loads(inline) if inline else None)))
            while (batch := next(batches, None)) is not None:
                r = _handled(h, batch)
                yield task, seq, "BATCH_OK" if r.success else "BATCH_FAILED", batch.batch_uid, _texts(r.metrics), r.reason_code, r.permanent
                seq += 1
                if not r.success:
                    yield task, seq, "TASK_FAILED", None, {}, r.reason_code, r.permanent
                    return
            yield task, seq, "TASK_DONE", None, _texts(h.finalize() or {}), None, False
        except Exception as e:  # user code outside a batch
            reason, permanent = h.classify_error(e)
            yield task, seq, "TASK_FAILED", None, {}, reason, permanent

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for task, inline in zip(pdf["task_id"], pdf["input_inline"], strict=True):
                for e in events(task, inline):
                    out.append(e)
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return tasks.select("task_id", "input_inline").mapInPandas(run, EVENTS)


def until_failure(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Results up to and with the first failed one of each key: what a worker that stops there would have told."""
    first = results.where(~F.col("success")).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return results.join(first, keys, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def run_batches(batches: DataFrame, handler: type[Handler], config: dict | None = None) -> DataFrame:
    """batches (task_id, batch_uid, payload) through a handler, each in its own call, in Arrow batches.

    Batches are independent here; until_failure() keeps what comes before a task's first failure. A null batch_uid becomes the hash of the payload. Exceptions are classified and become failed results.
    """
    given = batches.select("task_id", F.coalesce("batch_uid", stable_id("payload")).alias("batch_uid"), "payload")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = handler()
        h.init(config or {})
        for pdf in frames:
            out = []
            for task, uid, payload in zip(pdf["task_id"], pdf["batch_uid"], pdf["payload"], strict=True):
                r = _handled(h, Batch(payload, uid))
                out.append((task, uid, r.success, _texts(r.metrics), r.reason_code, r.permanent))
            yield pd.DataFrame(out, columns=["task_id", "batch_uid", "success", "metrics", "reason", "permanent"])

    return given.mapInPandas(run, RESULTS)


def run_local(handler: Handler, input_inline: dict | None = None) -> dict[str, Any]:
    """Driver-side run of one small task: stops at the first failed batch, without finalize."""
    handler.init({})
    events: list[tuple] = []
    for batch in handler.iter_batches(handler.load_input(None, input_inline)):
        r = _handled(handler, batch)
        events.append(("BATCH_OK" if r.success else "BATCH_FAILED", r))
        if not r.success:
            events.append(("TASK_FAILED", r))
            return {"events": events, "metrics": None}
    return {"events": [*events, ("TASK_DONE", None)], "metrics": handler.finalize()}
