"""A circuit breaker for calls to external models."""

from __future__ import annotations

import time
from collections.abc import Callable


class CircuitOpen(RuntimeError):
    """Calls are not tried for now."""


class CircuitBreaker:
    """Opens after `threshold` failures in a row; after `reset` seconds one call is tried, and its outcome decides."""

    def __init__(self, threshold: int = 5, reset: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.reset, self.clock = threshold, reset, clock
        self.failures, self.opened = 0, None

    def call(self, f: Callable, *args):
        if self.opened is not None and self.clock() - self.opened < self.reset:
            raise CircuitOpen
        try:
            result = f(*args)
        except Exception:
            self.failures += 1
            if self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return result
