"""A tree of cancellation: halting a status halts what was forked from it."""

from __future__ import annotations

import threading
from typing import Any


class RunStatus:
    def __init__(self, parent: RunStatus | None = None, values: dict | None = None):
        self.parent, self._values, self._halted, self._children, self.error = parent, dict(values or {}), threading.Event(), [], None
        if parent is not None:
            parent._children.append(self)
            if not parent.running:
                self.halt(parent.error)

    def fork(self) -> RunStatus:
        return RunStatus(self)

    def with_value(self, key: Any, value: Any) -> RunStatus:
        return RunStatus(self, {key: value})

    def value(self, key: Any) -> Any:
        at: RunStatus | None = self
        while at is not None:
            if key in at._values:
                return at._values[key]
            at = at.parent
        return None

    def halt(self, error: BaseException | None = None) -> None:
        if self._halted.is_set():
            return
        self.error = error
        self._halted.set()
        for c in list(self._children):
            c.halt(error)

    @property
    def running(self) -> bool:
        return not self._halted.is_set()

    def wait(self, seconds: float | None = None) -> bool:
        """Until halted; whether it was."""
        return self._halted.wait(seconds)
