"""Settings: defaults, then a JSON file, then environment variables, then overrides."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Settings of the coordinator; times in seconds have a twin in milliseconds, e.g. discovery_window_ms."""

    # Defaults.
    kafka_bootstrap: str = "localhost:9092"
    worker_types: tuple[str, ...] = field(default_factory=tuple)
    heartbeat_soft_sec: float = 300
    heartbeat_hard_sec: float = 3600
    lease_ttl_sec: float = 45
    discovery_window_sec: float = 8
    cancel_grace_sec: float = 30
    scheduler_tick_sec: float = 1.0
    finalizer_tick_sec: float = 5.0
    hb_monitor_tick_sec: float = 10.0
    outbox_dispatch_tick_sec: float = 0.25
    outbox_max_attempts: int = 12
    outbox_backoff_min_ms: int = 250
    outbox_backoff_max_ms: int = 60_000
    metrics_retention_days: int = 14

    def __getattr__(self, name: str) -> int:
        if name.endswith("_ms") and not name.startswith("_"):
            return int(object.__getattribute__(self, name[:-3] + "_sec") * 1000)
        raise AttributeError(name)


@dataclass(frozen=True)
class WorkerSettings:
    """Settings of a worker; they come from a file and overrides, never from the environment."""

    # Defaults.
    kafka_bootstrap: str = "localhost:9092"
    roles: tuple[str, ...] = field(default_factory=tuple)
    lease_ttl_sec: float = 60
    hb_interval_sec: float = 20
    pull_poll_ms: int = 300
    pull_empty_backoff_ms_max: int = 4000
    dedup_cache_size: int = 10_000
    dedup_ttl_ms: int = 3_600_000
    worker_state_retention_days: int = 7

    __getattr__ = Settings.__getattr__


#: Environment variables that set a field.
ENVIRONMENT = {"KAFKA_BOOTSTRAP_SERVERS": "kafka_bootstrap", "WORKER_TYPES": "worker_types"}


def _filled(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    for name in ("worker_types", "roles"):
        if isinstance(given := values.get(name), (str, list)):
            values[name] = tuple(x.strip() for x in (given.split(",") if isinstance(given, str) else given) if x.strip())
    return replace(kind(), **values)


def _file(path: str | None) -> dict[str, Any]:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load(path: str | None = None, env: Mapping[str, str] | None = None, **overrides: Any) -> Settings:
    """Defaults, then the file, then the environment, then overrides; unknown keys of the file and of overrides are errors."""
    values = _file(path)
    for name, key in ENVIRONMENT.items():
        if v := (os.environ if env is None else env).get(name):
            values[key] = v
    return _filled(Settings, values | overrides)


def load_worker(path: str | None = None, **overrides: Any) -> WorkerSettings:
    return _filled(WorkerSettings, _file(path) | overrides)
