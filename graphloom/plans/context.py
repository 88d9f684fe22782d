"""What a step sees while it runs: job-wide values, the store, hooks; and running one step alone with what it depends on."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.errors import ConfigError, GraphError
from .dag import DISABLED, FAILURE, PENDING, SUCCESS, StepSpec, check_steps

KINDS = ("entities", "relationships")


class GraphStore(Protocol):
    """What every store offers."""

    def write(self, objects: DataFrame) -> None: ...
    def read(self) -> DataFrame: ...
    def by_type(self, type: str) -> DataFrame: ...


@dataclass
class StepContext:
    """Collects frames by kind, lazily; nothing is computed before a flush or a lookup.

    ``given`` frames are visible to lookups but are not output. Hooks get and return frames; the one after is called
    when frames are flushed, with what was stored.
    """

    spark: SparkSession
    step: str
    values: dict = field(default_factory=dict)
    given: dict[str, DataFrame] = field(default_factory=dict)
    before: Callable[[DataFrame], DataFrame] = lambda df: df
    after: Callable[[str, DataFrame], None] = lambda kind, df: None
    stores: dict[str, GraphStore] = field(default_factory=dict)

    def __post_init__(self):
        self._buffer: dict[str, list[DataFrame]] = {k: [] for k in KINDS}
        self._stored: set[str] = set()
        self._lock = threading.Lock()

    def set(self, key: str, value) -> None:
        self.values[key] = value

    def get(self, key: str):
        return self.values.get(key)

    def delete(self, key: str) -> None:
        self.values.pop(key, None)

    def add(self, kind: str, objects: DataFrame) -> DataFrame:
        out = self.before(objects).withColumn("step_id", F.lit(self.step))
        with self._lock:
            self._buffer[kind].append(out)
        return out

    def _union(self, frames: list[DataFrame]) -> DataFrame | None:
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def buffered(self, kind: str) -> DataFrame | None:
        """What was added since the last flush."""
        return self._union(self._buffer[kind])

    def flush(self, kind: str) -> None:
        """Write the buffer to the store of the kind and empty it; flushes of several threads follow one another."""
        with self._lock:
            objects = self.buffered(kind)
            if objects is None:
                return
            if kind not in self.stores:
                raise ConfigError(f"no store of {kind}")
            self.stores[kind].write(objects)
            self._buffer[kind] = []
            self._stored.add(kind)
        self.after(kind, objects)

    def collected(self, kind: str) -> DataFrame | None:
        """All output of the kind: stored and buffered."""
        stored = [self.stores[kind].read()] if kind in self._stored else []
        return self._union([*stored, *self._buffer[kind]])

    def visible(self, kind: str) -> DataFrame | None:
        """What lookups see: given frames and output."""
        own = self.collected(kind)
        return self._union([f for f in (self.given.get(kind), own) if f is not None])

    def iterate(self, kind: str, type: str) -> DataFrame | None:
        seen = self.visible(kind)
        return None if seen is None else seen.where(F.col("_type") == type)

    def has_key(self, wanted: DataFrame, key: str, kind: str = "entities") -> DataFrame:
        """Rows of ``wanted`` with a flag ``known``: one join for all keys, never a lookup per key."""
        seen = self.visible(kind)
        if seen is None:
            return wanted.withColumn("known", F.lit(False))
        keys = seen.select(F.col("_key").alias("_seen_key")).distinct()
        return wanted.join(keys, F.col(key) == F.col("_seen_key"), "left").withColumn("known", F.col("_seen_key").isNotNull()).drop("_seen_key")


def ancestors(steps: list[StepSpec], step: str) -> set[str]:
    """Ids of all transitive dependencies."""
    above = {s.id: s.depends_on for s in steps}
    out, queue = set(), list(above[step])
    while queue:
        if (x := queue.pop()) not in out:
            out.add(x)
            queue.extend(above[x])
    return out


def dependencies_complete(steps: list[StepSpec], step: str, status: dict[str, str]) -> bool:
    """Whether no transitive dependency is still to be run."""
    return all(status.get(a, PENDING) != PENDING for a in ancestors(steps, step))


def without(steps: list[StepSpec], started: str) -> list[StepSpec]:
    """The steps left once one has started: no other step waits for it any more."""
    return [StepSpec(s.id, s.name, s.types, s.partial_types, tuple(d for d in s.depends_on if d != started), s.graph_id, s.ingestion_source, s.run) for s in steps if s.id != started]


def wrapped(step: StepSpec, around: Callable[[Callable], Callable]) -> StepSpec:
    """The step with its handler inside a wrapper."""
    return StepSpec(step.id, step.name, step.types, step.partial_types, step.depends_on, step.graph_id, step.ingestion_source, around(step.run) if step.run else None)


def run_checked(validate: Callable[[dict], None] | None, context: dict, run: Callable[[], object]):
    """Run after a check of the configuration; a check that fails ends the run as a fatal error."""
    if validate:
        try:
            validate(context)
        except GraphError:
            raise
        except Exception as e:
            raise ConfigError(str(e)) from e
    return run()


def run_with_dependencies(spark: SparkSession, steps: list[StepSpec], step: str, context: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """(frames of the step alone, all keys seen): its dependencies run first and their output is visible to it."""
    order, needed = check_steps(steps), ancestors(steps, step)
    by_id, out = {s.id: s for s in steps}, {}
    for i in [x for x in order if x in needed] + [step]:
        out[i] = by_id[i].run(spark, context or {}, out) if by_id[i].run else {}
    keys = None
    for frames in out.values():
        for f in frames.values():
            k = f.select("_key")
            keys = k if keys is None else keys.unionAll(k)
    return out[step], keys if keys is None else keys.distinct()


def summary(status: dict[str, str], undeclared: dict[str, list[str]] = {}, partial: list[str] = ()) -> str:  # noqa: B006
    """Text of a run's results: status by step, undeclared types of successful steps, types that may be incomplete."""
    lines = [f"{'-' if s == DISABLED else 'x' if s == FAILURE else '+'} {i}: {s}" for i, s in status.items()]
    lines += [f"! {i} made undeclared types: {', '.join(t)}" for i, t in undeclared.items() if t and status.get(i) == SUCCESS]
    lines += [f"! incomplete: {', '.join(partial)}"] if partial else []
    return "\n".join(lines)


@contextlib.contextmanager
def fresh_storage(spark: SparkSession, root: str):
    """A storage root emptied of what an earlier run left."""
    from ..sources.files import remove_storage

    remove_storage(spark, root)
    yield root
