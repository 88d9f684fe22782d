"""Events of a run: published one after the other, never failing the run; and what a log may show of a configuration."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import Field, masked_fields

MASK = "***"


@dataclass
class EventQueue:
    """Publishes events in order, one at a time; a failure is logged and the next goes on. Without a job nothing is published."""

    publish: Callable[[dict], None]
    job: str | None = None
    log: logging.Logger = field(default_factory=lambda: logging.getLogger("graphloom.events"))

    def __post_init__(self):
        self._worker = ThreadPoolExecutor(max_workers=1)
        self._waiting: list = []

    def enqueue(self, name: str, description: str) -> None:
        if self.job:
            self._waiting.append(self._worker.submit(self._send, {"name": name, "description": description}))

    def _send(self, event: dict) -> None:
        try:
            self.publish(event)
        except Exception:
            self.log.exception("failed to publish an event")

    def on_idle(self) -> None:
        """Return when all events so far have been published or have failed."""
        wait(self._waiting)
        self._waiting = []


class StepLog:
    """A logger of a run's steps: every message also goes to the queue as an event."""

    def __init__(self, queue: EventQueue, fields: Mapping[str, Field] | None = None):
        self.queue, self.fields = queue, fields or {}

    def step_start(self, step: str) -> None:
        self.queue.enqueue("step_start", f"Starting step {step}")

    def step_end(self, step: str, status: str) -> None:
        self.queue.enqueue("step_end", f"Completed step {step}: {status}")

    def step_failure(self, step: str, error: BaseException) -> None:
        self.queue.enqueue("step_failure", f"Step {step} failed (errorCode={getattr(error, 'code', 'UNEXPECTED_ERROR')}, reason={error})")

    def shown(self, values: Mapping) -> dict:
        return shown(self.fields, values)


def shown(fields: Mapping[str, Field], values: Mapping) -> dict:
    """A configuration as a log may show it: masked fields and fields that are not declared are hidden."""
    hidden = set(masked_fields(fields))
    return {k: v if k in fields and k not in hidden else MASK for k, v in values.items()}


def shown_column(fields: Mapping[str, Field], name: Column, value: Column) -> Column:
    """:func:`shown` over rows of names and values."""
    open_ = [n for n in fields if n not in masked_fields(fields)]
    return F.when(name.isin(open_), value).otherwise(F.lit(MASK)) if open_ else F.lit(MASK)


def log_uncaught(log: logging.Logger):
    """Send exceptions that nothing catches to a logger; returns a function that undoes it."""
    before = sys.excepthook

    def hook(kind, error, trace):
        if not issubclass(kind, KeyboardInterrupt):
            log.critical("uncaught exception", exc_info=(kind, error, trace))
        before(kind, error, trace)

    sys.excepthook = hook
    return lambda: setattr(sys, "excepthook", before)
