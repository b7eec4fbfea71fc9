"""Log events and stage timings."""

from __future__ import annotations

import faulthandler
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

NAME = "siltstone"


def logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)


def configure(verbosity: int = 0) -> None:
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logger().setLevel([logging.WARNING, logging.INFO, logging.DEBUG][min(verbosity, 2)])
    if verbosity:
        faulthandler.enable()


def event(log: logging.Logger, message: str, level: int = logging.INFO, **values: object) -> None:
    """``message | k=v ...``; values of None are left out."""
    tail = " ".join(f"{k}={v}" for k, v in values.items() if v is not None)
    log.log(level, f"{message} | {tail}" if tail else message)


class Stopwatch:
    def __init__(self) -> None:
        self.began, self.ended = time.monotonic(), None

    def stop(self) -> None:
        self.ended = self.ended if self.ended is not None else time.monotonic()

    @property
    def seconds(self) -> float:
        return max(0.0, (self.ended if self.ended is not None else time.monotonic()) - self.began)

    @property
    def ms(self) -> int:
        return int(self.seconds * 1000)


@contextmanager
def measured() -> Iterator[Stopwatch]:
    watch = Stopwatch()
    try:
        yield watch
    finally:
        watch.stop()


class Timings:
    """Seconds by stage."""

    def __init__(self) -> None:
        self.total: dict[str, float] = {}

    def add(self, stage: str, seconds: float) -> None:
        self.total[stage] = self.total.get(stage, 0.0) + seconds

    def seconds(self, stage: str) -> float:
        return self.total.get(stage, 0.0)

    def ms(self, stage: str) -> int:
        return int(self.seconds(stage) * 1000)

    def all_ms(self) -> dict[str, int]:
        return {k: self.ms(k) for k in self.total}
