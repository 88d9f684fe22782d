"""Declared metadata of steps: classes and types, the catalogue of all steps, its document and its graph of types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.errors import ConfigError
from ..model.registry import ClassSchema, Property, Registry, default_registry
from ..operators import build


@dataclass(frozen=True)
class EntityMeta:
    """An entity type that a step declares."""

    type: str
    resource: str
    classes: tuple[str, ...]
    schema: ClassSchema | None = None


@dataclass(frozen=True)
class RelationshipMeta:
    """A relationship type; mapped ones have a direction and may aim at types that no step declares."""

    type: str
    cls: str
    source: str
    target: str
    direction: str | None = None

    @property
    def identity(self) -> tuple:
        return (self.source, self.target, self.cls, self.type, self.direction)


def entity_metadata(resource: str, classes: list[str], type: str, *, registry: Registry | None = None, extension: dict[str, Property] | None = None):
    """(metadata with the schema merged of all classes, a builder of such entities from a frame)."""
    known = registry or default_registry()
    meta = EntityMeta(type, resource, tuple(classes), known.merged(list(classes), extension))

    def entities(source: DataFrame, key: Column, step: str, assign: dict[str, Column] | None = None) -> DataFrame:
        if unknown := set(assign or {}) - set(meta.schema.properties):
            raise ConfigError(f"{type} has no properties {sorted(unknown)}")
        return build.entities(source, type=type, classes=list(classes), key=key, step=step, assign=assign, registry=known)

    return meta, entities


@dataclass
class Catalogue:
    """All declared types, each once, sorted: entities by type, relationships by source, target, class and direction."""

    entities: list[EntityMeta]
    relationships: list[RelationshipMeta]
    mapped: list[RelationshipMeta]


def catalogue(steps: list[tuple[str, list]], order: list[str] | None = None) -> Catalogue:
    """The catalogue of steps (id, metadata); of repeated types and relationships the first, in ``order`` of the steps, stays."""
    by_id = dict(steps)
    entities, direct, mapped = {}, {}, {}
    for step in order or list(by_id):
        for m in by_id.get(step, ()):
            if isinstance(m, EntityMeta):
                entities.setdefault(m.type, m)
            else:
                (mapped if m.direction else direct).setdefault(m.identity, m)
    by_ends = lambda m: (m.source, m.target, m.cls, m.direction or "")
    return Catalogue(sorted(entities.values(), key=lambda e: e.type), sorted(direct.values(), key=by_ends), sorted(mapped.values(), key=by_ends))


def _table(head: list[str], rows: list[list[str]]) -> str:
    width = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(head), line(["-" * w for w in width]), *map(line, rows)])


def document(c: Catalogue) -> str:
    """The catalogue in Markdown: a section for each kind that has any types."""
    out = ["## Data Model"]
    if c.entities:
        rows = [[e.resource, f"`{e.type}`", ", ".join(f"`{x}`" for x in e.classes)] for e in c.entities]
        out.append("### Entities\n\nThe following entities are created:\n\n" + _table(["Resources", "Entity `_type`", "Entity `_class`"], rows))
    if c.relationships:
        rows = [[f"`{r.source}`", f"**{r.cls}**", f"`{r.target}`"] for r in c.relationships]
        out.append("### Relationships\n\nThe following relationships are created:\n\n" + _table(["Source Entity `_type`", "Relationship `_class`", "Target Entity `_type`"], rows))
    if c.mapped:
        rows = [[f"`{r.source}`", f"**{r.cls}**", f"`*{r.target}*`", r.direction] for r in c.mapped]
        out.append("### Mapped Relationships\n\nThe following mapped relationships are created:\n\n" + _table(["Source Entity `_type`", "Relationship `_class`", "Target Entity `_type`", "Direction"], rows))
    return "\n\n".join(out)


def put_section(old: str, section: str, start: str, end: str) -> str:
    """A document with what stands between two markers replaced; appended where the first marker is missing, an error where only the second is."""
    block = f"{start}\n{section}\n{end}"
    head, found, rest = old.partition(start)
    if not found:
        return f"{old}\n\n{block}"
    _, closed, tail = rest.partition(end)
    if not closed:
        raise ConfigError("a start marker without its end marker")
    return head + block + tail


def type_graph(spark: SparkSession, c: Catalogue, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind; edges: source, target, label, mapped) of the declared types, or of those edges that touch ``types``.

    A mapped target that no entity declares is a placeholder; mapped edges are oriented by their direction; a mapped edge that a
    direct one equals is left out.
    """
    e = spark.createDataFrame([(m.type,) for m in c.entities], "id string")
    r = spark.createDataFrame([(m.source, m.target, m.cls, m.direction) for m in (*c.relationships, *c.mapped)], "source string, target string, label string, direction string")
    if types is not None:
        e = e.where(F.col("id").isin(types))
        r = r.where(F.col("source").isin(types) | F.col("target").isin(types))
    mapped = F.col("direction").isNotNull()
    placeholders = r.where(mapped).select(F.col("target").alias("id")).distinct().join(e, "id", "left_anti")
    nodes = e.withColumn("kind", F.lit("entity")).unionByName(placeholders.withColumn("kind", F.lit("placeholder")))
    back = F.col("direction") == "REVERSE"
    ends = r.select(F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"), "label", mapped.alias("mapped"))
    edges = ends.groupBy("source", "target", "label").agg(F.bool_and("mapped").alias("mapped"))
    return nodes, edges


def authorization(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, items): the distinct non-empty entries of list columns over all rows, sorted."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in columns]))
    entries = rows.select(each.alias("x")).select("x.kind", F.explode("x.v").alias("item")).where("item <> ''")
    return entries.groupBy("kind").agg(F.array_sort(F.collect_set("item")).alias("items"))


def conformance(spec: DataFrame, code: DataFrame) -> DataFrame:
    """Rows of declared metadata on one side alone, with ``side``: only_in_spec or only_in_code."""
    return spec.exceptAll(code).withColumn("side", F.lit("only_in_spec")).unionByName(code.exceptAll(spec).withColumn("side", F.lit("only_in_code")))


def undeclared(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """(step_id, _type, problem): types that steps made and do not declare, or declare and did not make."""
    made = objects.select("step_id", "_type").distinct().withColumn("_made", F.lit(True))
    j = made.join(declared.select("step_id", "_type").distinct().withColumn("_said", F.lit(True)), ["step_id", "_type"], "full_outer")
    return j.where("_made IS NULL OR _said IS NULL").select("step_id", "_type", F.when(F.col("_made").isNull(), "not_produced").otherwise("undeclared").alias("problem"))
