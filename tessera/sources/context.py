"""What a handler runs in: a flag that cancels it, time that is left, processes, temporary paths, clean-up in reverse order."""

from __future__ import annotations

import contextlib
import os
import shutil
import signal
import subprocess
import threading
import time
from collections.abc import Callable
from typing import Any


class Cancelled(Exception):
    """The run was cancelled; reason and deadline are on the context."""


class RunContext:
    """Use as a context manager: leaving it runs the clean-up, whatever happened inside."""

    def __init__(self, task_id: str, node_id: str = "", attempt_epoch: int = 0, worker_id: str = "", now_ms: Callable[[], int] | None = None):
        self.task_id, self.node_id, self.attempt_epoch, self.worker_id = task_id, node_id, attempt_epoch, worker_id
        self.now_ms = now_ms or (lambda: int(time.time() * 1000))
        self.kv: dict[str, Any] = {}
        self.reason: str | None = None
        self.deadline_ms: int | None = None
        self._flag = threading.Event()
        self._stack = contextlib.ExitStack()

    def cancel(self, reason: str, deadline_ms: int | None = None) -> None:
        self.reason, self.deadline_ms = reason, deadline_ms
        self._flag.set()

    def cancelled(self) -> bool:
        return self._flag.is_set()

    def remaining_ms(self) -> float | None:
        """Time until the deadline of a cancellation, never negative; None without one."""
        return None if not self.deadline_ms else max(0.0, float(self.deadline_ms - self.now_ms()))

    def raise_if_cancelled(self) -> None:
        if self._flag.is_set():
            raise Cancelled(self.reason)

    def sleep(self, seconds: float) -> None:
        """A wait that a cancellation ends."""
        if self._flag.wait(seconds):
            raise Cancelled(self.reason)

    def on_cleanup(self, f: Callable[[], Any]) -> None:
        """Run f at the end; the last one given runs first, and an error in one does not keep the others from running."""

        def quietly() -> None:
            with contextlib.suppress(Exception):
                f()

        self._stack.callback(quietly)

    def temp_path(self, path: str) -> str:
        """A file or folder that is removed at the end."""
        self.on_cleanup(lambda: shutil.rmtree(path) if os.path.isdir(path) else os.remove(path))
        return path

    def run(self, *command: str, grace_ms: int = 5000, poll_sec: float = 0.05) -> int:
        """Run a process in a group of its own; a cancellation ends the group, by force after the grace time."""
        self.raise_if_cancelled()
        process = subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        try:
            while process.poll() is None:
                self.sleep(poll_sec)
            return process.returncode
        finally:
            if process.poll() is None:
                with contextlib.suppress(ProcessLookupError):
                    os.killpg(process.pid, signal.SIGTERM)
                try:
                    process.wait(max(0.001, grace_ms / 1000))
                except subprocess.TimeoutExpired:
                    with contextlib.suppress(ProcessLookupError):
                        os.killpg(process.pid, signal.SIGKILL)
                    process.wait()

    def __enter__(self) -> RunContext:
        return self

    def __exit__(self, *error: Any) -> None:
        self._stack.close()
