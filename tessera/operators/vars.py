"""Nested task variables as flat maps from dotted path to JSON text.

A tree is stored by its leaves, so setting, merging and removing are map functions, and a subtree without leaves is
gone by itself. Writing a path removes what stood above or below it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of paths and values.
MAX_PATHS = 256
MAX_DEPTH = 16
MAX_SEGMENTS = 14  # below the prefix under which variables are kept
MAX_PATH_CHARS = 512
MAX_SEGMENT_CHARS = 128
MAX_VALUE_BYTES = 64 * 1024


class VarsError(ValueError):
    """A path or value that variables can't hold."""


def check_path(path: str) -> str:
    parts = path.split(".")
    if any(not p or p.startswith("$") or "\x00" in p or len(p) > MAX_SEGMENT_CHARS for p in parts):
        raise VarsError(f"bad segment in path {path!r}")
    if len(path) > MAX_PATH_CHARS or len(parts) > MAX_SEGMENTS:
        raise VarsError(f"path too long or too deep: {path[:40]!r}")
    return path


def check_value(value: Any) -> str:
    """The value as JSON text, within the byte limit."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda b: b.decode("utf-8", "replace") if isinstance(b, bytes) else str(b))
    size = len(value.encode()) if isinstance(value, str) else len(value) if isinstance(value, bytes) else len(text.encode())
    if size > MAX_VALUE_BYTES:
        raise VarsError("value too large")
    return text


def flatten(tree: Mapping[str, Any], at: str = "") -> dict[str, Any]:
    """Leaves by dotted path: mappings are branches, lists and scalars leaves; an empty mapping has none."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        path = f"{at}.{k}" if at else str(k)
        if isinstance(v, Mapping):
            out |= flatten(v, path)
        else:
            out[path] = v
    return out


def assignments(values: Mapping[str, Any], detector: Callable[[str, Any], bool] | None = None) -> dict[str, str]:
    """Checked path -> JSON of keyword arguments: nested mappings are flattened, but a dotted key keeps its mapping."""
    flat: dict[str, Any] = {}
    for k, v in values.items():
        flat |= {k: v} if "." in k or not isinstance(v, Mapping) else flatten(v, k)
    if len(flat) > MAX_PATHS:
        raise VarsError("too many paths")
    if detector:
        hit = sorted(k for k, v in flat.items() if detector(k, v))
        if hit:
            raise VarsError(f"sensitive values: {', '.join(hit)}")
    return {check_path(k): check_value(v) for k, v in flat.items()}


def _bound(f: Callable[..., Column], *columns: Column) -> Column:
    """f over columns that stand in the expression once each, however often f uses them.

    Chained calls would otherwise repeat what they are made of, and grow as a power of their number.
    """
    held = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(held), lambda s: f(*[s[f"_{i}"] for i in range(len(columns))])), F.lit(0))


def _clash(old: Column, new: Column) -> Column:
    """Whether a leaf is displaced by a new one: the same path, or one above or below it."""
    return old.startswith(F.concat(new, F.lit("."))) | new.startswith(F.concat(old, F.lit("."))) | (old == new)


def merged(left: Column, right: Column) -> Column:
    """left with right's leaves written over it; a new leaf displaces leaves below and above it."""
    keep = lambda a, b: F.map_filter(a, lambda k, _: ~F.exists(F.map_keys(b), lambda n: _clash(k, n)))
    return _bound(lambda a, b: F.map_concat(keep(a, b), b), left, right)


def set_values(current: Column, values: Mapping[str, Any], detector: Callable[[str, Any], bool] | None = None) -> Column:
    given = assignments(values, detector)
    if not given:
        return current
    return merged(current, F.create_map(*[F.lit(x) for kv in sorted(given.items()) for x in kv]))


def unset(current: Column, *paths: str) -> Column:
    """Without the given paths and all below them. Empty branches need no pruning: they have no leaves."""
    for p in paths:
        check_path(p)
    gone = lambda k: F.exists(F.array(*[F.lit(p) for p in paths]), lambda p: (k == p) | k.startswith(F.concat(p, F.lit("."))))
    return F.map_filter(current, lambda k, _: ~gone(k)) if paths else current


def checked_step(by: Any) -> float:
    if isinstance(by, bool) or not isinstance(by, (int, float)) or not math.isfinite(by):
        raise VarsError("increments are finite numbers")
    return by


def _added(tree: Column, path: Column, by: Column) -> Column:
    """tree with by added to the leaf at path; path and by are bound by the caller."""
    old = F.element_at(tree, path)
    number = old.try_cast("double")
    bad = old.isNotNull() & number.isNull()
    new = F.when(bad, F.raise_error(F.concat(path, F.lit(" is not a number"))).cast("double")).otherwise(F.coalesce(number, F.lit(0.0)) + by)
    rest = F.map_filter(tree, lambda k, _: ~_clash(k, path))
    return F.map_concat(rest, F.map_from_arrays(F.array(path), F.array(new.cast("string"))))


def increment(current: Column, path: str, by: float = 1) -> Column:
    """Adds to a numeric leaf, made if missing; a leaf that is no number fails the query. Many at once: increments()."""
    return increments(current, [(path, by)])


def increments(current: Column, steps: list[tuple[str, float]]) -> Column:
    """Adds step after step, in one pass over an array: the expression grows by a literal for each of them."""
    if not steps:
        return current
    todo = F.array(*[F.struct(F.lit(check_path(p)).alias("path"), F.lit(float(checked_step(by))).alias("by")) for p, by in steps])
    return F.aggregate(todo, current, lambda tree, s: _added(tree, s["path"], s["by"]))


def touched(*paths: str) -> int:
    """How many paths an unset is asked for, present or not."""
    return len({check_path(p) for p in paths})


def subtree(current: Column, path: str) -> Column:
    """The leaves at and below a path, named from there on ('' is the path itself); an empty map for a missing path."""
    check_path(path)
    at, below = F.lit(path), F.lit(path + ".")
    inside = F.map_filter(current, lambda k, _: (k == at) | k.startswith(below))
    return F.transform_keys(inside, lambda k, _: F.when(k == at, F.lit("")).otherwise(F.substring(k, F.lit(len(path) + 2), F.length(k))))


def counters(deltas: DataFrame, keys: list[str], by: str = "by") -> DataFrame:
    """Additive fold of a log of increments."""
    return deltas.groupBy(*keys).agg(F.sum(by).alias("value"))
