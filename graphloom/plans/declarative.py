"""Steps declared as data: what to read, how to name and type it, what it relates to. Each compiles to a step of DataFrame builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.errors import ConfigError
from ..operators import build
from .dag import StepSpec

SINGLETON, LIST = "SINGLETON", "LIST"


def kind(step: dict) -> str:
    """singleton, child-singleton, fetch-entities or fetch-child-entities, by response type and parent."""
    child = bool(step.get("parentAssociation"))
    if step["response"]["responseType"] == SINGLETON:
        return "child-singleton" if child else "singleton"
    return "fetch-child-entities" if child else "fetch-entities"


def _path(dotted: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in dotted.split(".")))


def project(step: dict, rows: DataFrame) -> DataFrame:
    """The entities of a step's rows: key by path, mapped fields by dotted paths, static fields as they are."""
    e = step["entity"]
    if "_keyPath" not in e:
        raise ConfigError(f"step {step['id']} has no key path")
    classes = [e["_class"]] if isinstance(e["_class"], str) else list(e["_class"])
    assign = {n: _path(p) for n, p in e.get("fieldMappings", {}).items()} | {n: F.lit(v) for n, v in e.get("staticFields", {}).items()}
    return build.entities(rows, type=e["_type"], classes=classes, key=_path(e["_keyPath"]).cast("string"), step=step["id"], assign=assign)


def relationships(step: dict, rows: DataFrame, parent_key: str = "_parent_key") -> dict[str, DataFrame]:
    """Direct relationships (to the parent, whose key rows carry, and to targets named by a path of the row) and mapped ones, by name."""
    e, out = step["entity"], {}
    own = _path(e["_keyPath"]).cast("string")

    def direct(cls, key, type, forward):
        ends = dict(from_key=own, to_key=key, from_type=e["_type"], to_type=type) if forward else dict(from_key=key, to_key=own, from_type=type, to_type=e["_type"])
        return build.relationships(rows, cls, step=step["id"], **ends)

    if p := step.get("parentAssociation"):
        out["parent"] = direct(p["relationshipClass"], F.col(parent_key), p["parentEntityType"], False)
    for i, r in enumerate(step.get("directRelationships", ())):
        out[f"direct{i}"] = direct(r["_class"], _path(r["targetKey"]).cast("string"), r["targetType"], r["direction"] == "FORWARD")
    for i, r in enumerate(step.get("mappedRelationships", ())):
        m = r["mappings"]
        m = m if isinstance(m, list) else [m]
        target = {x["targetProperty"]: _path(x["sourceProperty"]) if "sourceProperty" in x else F.lit(x["targetValue"]) for x in m}
        out[f"mapped{i}"] = build.mapped_relationships(rows, r["_class"], source_key=own, source_type=e["_type"], target=target, filter_keys=[sorted(target)], direction=r["direction"], step=step["id"])
    return out


def compile_step(step: dict, read: Callable[[dict, dict], DataFrame]) -> StepSpec:
    """A runnable step. ``read`` gets the declaration and the frames made so far, and returns rows; of a singleton there is one row."""

    def run(spark, context, made):
        rows = read(step, made)
        if step["response"]["responseType"] == SINGLETON:
            rows = rows.limit(1)
        return {"entities": project(step, rows), **relationships(step, rows)}

    return StepSpec(step["id"], step.get("name", ""), types=(step["entity"]["_type"],), depends_on=tuple(step.get("dependsOn", ())), run=run)


def compile_template(template: dict, read: Callable[[dict, dict], DataFrame]) -> list[StepSpec]:
    """All steps of a template ``{"template": {"steps": [...]}}`` or ``{"steps": [...]}``; ids are distinct."""
    steps = template.get("template", template)["steps"]
    if len({s["id"] for s in steps}) < len(steps):
        raise ConfigError("a step id repeats")
    return [compile_step(s, read) for s in steps]
