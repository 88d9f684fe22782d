"""Steps and their dependency graph: order, closure, status and metadata."""

from __future__ import annotations

import graphlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.errors import GraphError, UnaccountedStepError, UnknownStepError

SUCCESS, FAILURE, PARTIAL, CACHED, DISABLED, PENDING = "success", "failure", "partial_success_due_to_dependency_failure", "cached", "disabled", "pending_evaluation"
DEFAULT_GRAPH = "default"


@dataclass(frozen=True)
class StepSpec:
    """A step: what it declares, what it depends on and how it runs."""

    id: str
    name: str = ""
    types: tuple[str, ...] = ()
    partial_types: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    graph_id: str | None = None
    ingestion_source: str | None = None
    run: Callable | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.id in self.depends_on:
            raise GraphError(f"step {self.id} depends on itself")


def check_steps(steps: list[StepSpec]) -> list[str]:
    """Ids in an order in which dependencies come first; unknown dependencies and cycles raise."""
    known = {s.id for s in steps}
    for s in steps:
        if missing := set(s.depends_on) - known:
            raise GraphError(f"step {s.id} depends on unknown steps {sorted(missing)}")
    try:
        return list(graphlib.TopologicalSorter({s.id: s.depends_on for s in steps}).static_order())
    except graphlib.CycleError as e:
        raise GraphError(f"dependency cycle: {e.args[1]}") from e


def check_start_states(steps: list[StepSpec], states: dict[str, bool]) -> None:
    known = {s.id for s in steps}
    if unknown := set(states) - known:
        raise UnknownStepError(f"unknown steps {sorted(unknown)}")
    if missing := known - set(states):
        raise UnaccountedStepError(f"steps without a start state {sorted(missing)}")


def steps_frame(spark: SparkSession, steps: list[StepSpec]) -> DataFrame:
    """(ordinal, step_id, types, partial_types, depends_on, graph_id, ingestion_source)."""
    rows = [(i, s.id, list(s.types), list(s.partial_types), list(s.depends_on), s.graph_id, s.ingestion_source) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "ordinal int, step_id string, types array<string>, partial_types array<string>, depends_on array<string>, graph_id string, ingestion_source string")


def closure(steps: DataFrame) -> DataFrame:
    """(step_id, ancestor) for all transitive dependencies. Steps are metadata: their graph is walked on the driver, each step once."""
    above = {r["step_id"]: list(r["depends_on"] or ()) for r in steps.select("step_id", "depends_on").collect()}
    rows = []
    for step in above:
        seen, queue = set(), list(above[step])
        while queue:
            if (x := queue.pop()) not in seen:
                seen.add(x)
                queue.extend(above.get(x, ()))
        rows += [(step, x) for x in sorted(seen)]
    return steps.sparkSession.createDataFrame(rows, "step_id string, ancestor string")


def final_status(steps: DataFrame, own: DataFrame) -> DataFrame:
    """(step_id, status) from own outcomes (step_id, outcome: success, failure or disabled).

    A disabled step, or one with a disabled ancestor, is disabled; a failed one failed; one with a failed ancestor still runs and is a
    partial success.
    """
    up = closure(steps).join(own.withColumnsRenamed({"step_id": "ancestor", "outcome": "ancestor_outcome"}), "ancestor")
    flags = up.groupBy("step_id").agg(F.bool_or(F.col("ancestor_outcome") == "disabled").alias("d"), F.bool_or(F.col("ancestor_outcome") == "failure").alias("f"))
    j = own.join(flags, "step_id", "left")
    status = F.when((F.col("outcome") == "disabled") | F.coalesce("d", F.lit(False)), DISABLED).when(F.col("outcome") == "failure", FAILURE).when(F.coalesce("f", F.lit(False)), PARTIAL).otherwise(SUCCESS)
    return j.select("step_id", status.alias("status"))


@dataclass
class StepResult:
    """What became of a step: status, objects by type, types it made but does not declare, types that may be incomplete."""

    id: str
    status: str
    counts: dict[str, int] = field(default_factory=dict)
    undeclared: tuple[str, ...] = ()
    partial_types: tuple[str, ...] = ()
    error: str | None = None


@dataclass
class Pipeline:
    """Runs steps in dependency order; each returns frames by collection name. Graphs run one after the other.

    A step's frames are computed when it runs, so that its status is that of the computation and later steps read what was made: ``keep`` gets
    (step, collection, frame) and returns the frame to go on with, by default the same one, persisted. Steps in ``cache`` are not run; their frames are taken.
    After a run ``results`` has one :class:`StepResult` per step.
    """

    steps: list[StepSpec]
    graph_order: tuple[str, ...] = ()
    before: Callable[[DataFrame], DataFrame] | None = None
    keep: Callable[[str, str, DataFrame], DataFrame] = lambda step, name, df: df.persist()
    results: dict[str, StepResult] = field(default_factory=dict)

    def graphs(self) -> list[str]:
        named = {s.graph_id for s in self.steps if s.graph_id}
        if unlisted := named - set(self.graph_order):
            raise GraphError(f"graphs that would never run: {sorted(unlisted)}")
        order = [DEFAULT_GRAPH, *self.graph_order]
        at = {s.id: order.index(s.graph_id or DEFAULT_GRAPH) for s in self.steps}
        if late := [(s.id, d) for s in self.steps for d in s.depends_on if at.get(d, 0) > at[s.id]]:
            raise GraphError(f"steps that would run before what they depend on: {late}")
        return order

    def run(self, spark: SparkSession, context: dict | None = None, disabled: set[str] = frozenset(), cache: dict[str, dict[str, DataFrame]] | None = None) -> tuple[dict[str, dict[str, DataFrame]], dict[str, str]]:
        """(frames by step and collection, status by step)."""
        order = check_steps(self.steps)
        by_id = {s.id: s for s in self.steps}
        out: dict[str, dict[str, DataFrame]] = {}
        self.results = {}
        for graph in self.graphs():
            for i in (x for x in order if (by_id[x].graph_id or DEFAULT_GRAPH) == graph):
                self.results[i] = self._one(spark, by_id[i], context or {}, out, disabled, (cache or {}).get(i))
        return out, {i: r.status for i, r in self.results.items()}

    def _one(self, spark, s: StepSpec, context: dict, out: dict, disabled, cached) -> StepResult:
        above = [self.results[d].status for d in s.depends_on]
        if s.id in disabled or DISABLED in above:
            return StepResult(s.id, DISABLED)
        if cached is not None:
            out[s.id] = cached
            return StepResult(s.id, CACHED, self._counts(cached))
        try:
            made = s.run(spark, context, out) if s.run else {}
            made = {k: self.keep(s.id, k, self.before(v) if self.before else v) for k, v in made.items()}
            counts = self._counts(made)
        except Exception as e:
            if getattr(e, "fatal", False):
                raise
            return StepResult(s.id, FAILURE, partial_types=s.types, error=str(e))
        out[s.id] = made
        partial = FAILURE in above or PARTIAL in above
        undeclared = tuple(sorted(set(counts) - {*s.types})) if s.types else ()
        return StepResult(s.id, PARTIAL if partial else SUCCESS, counts, undeclared, tuple(dict.fromkeys((*s.partial_types, *(s.types if partial else ())))))

    @staticmethod
    def _counts(frames: dict[str, DataFrame]) -> dict[str, int]:
        """Rows by type; this computes the frames."""
        out: dict[str, int] = {}
        for df in frames.values():
            rows = df.groupBy("_type").count().collect() if "_type" in df.columns else [("", df.count())]
            for kind, n in rows:
                out[kind] = out.get(kind, 0) + n
        return out

    def partial_types(self) -> list[str]:
        """Types that may be incomplete after the run: of failed steps, of those below them, and those declared so."""
        return sorted({t for r in self.results.values() for t in r.partial_types})


def cache_path(spark: SparkSession, root: str, steps: list[StepSpec], running: str, step: str) -> str | None:
    """Where a step's cached output lies: None unless the running step depends on it and it is there."""
    from ..sources.files import exists
    from .context import ancestors

    path = f"{root.rstrip('/')}/{step}"
    return path if step in ancestors(steps, running) and exists(spark, path) else None


def select_steps(steps: list[StepSpec], wanted: set[str]) -> dict[str, bool]:
    """Which steps a local run enables: the wanted ones and all that they depend on; all of them where none is wanted. An unknown one raises."""
    from .context import ancestors

    if unknown := wanted - {s.id for s in steps}:
        raise UnknownStepError(f"unknown steps {sorted(unknown)}")
    need = wanted.union(*(ancestors(steps, w) for w in wanted))
    return {s.id: not wanted or s.id in need for s in steps}


def start_states(steps: list[StepSpec], disabled_sources: tuple[str, ...] = ()) -> dict[str, dict]:
    """Start states by step: a step of a disabled ingestion source is disabled, with the reason."""
    off = set(disabled_sources)
    return {s.id: {"disabled": True, "reason": "USER_CONFIG"} if s.ingestion_source in off else {"disabled": False, "reason": None} for s in steps}


def source_children(steps: list[StepSpec]) -> dict[str, list[str]]:
    """Steps that depend on a step of each ingestion source, sorted."""
    source = {s.id: s.ingestion_source for s in steps}
    out: dict[str, set[str]] = {s.ingestion_source: set() for s in steps if s.ingestion_source}
    for s in steps:
        for d in s.depends_on:
            if source.get(d):
                out[source[d]].add(s.id)
    return {k: sorted(v) for k, v in out.items()}


def execution_order(steps: list[StepSpec], step: str) -> list[str]:
    """A step's transitive dependencies in an order in which they can run, and the step."""
    from .context import ancestors

    need = ancestors(steps, step)
    return [i for i in check_steps(steps) if i in need] + [step]
