"""Builders of entities and relationships: each is one projection over a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert, keys
from ..model.errors import InvalidRelationshipClassError, MissingTargetKeyError
from ..model.registry import Registry, default_registry

#: Source properties from which a creation time is taken, in this order.
CREATION_NAMES = ("createdAt", "creationDate", "creationTime", "creationTimestamp")
#: Fixed patterns of statuses.
ACTIVE, INACTIVE = r"(?i)((?<!in)active|enabled|online)", r"(?i)(inactive|disabled|offline)"


def active_flag(status: Column) -> Column:
    """True or false by the words of a status, null if it has none of them."""
    return F.when(status.rlike(ACTIVE), True).when(status.rlike(INACTIVE), False)


def created_on(source: DataFrame) -> Column:
    """Epoch milliseconds from the first creation property that can be read; null without one."""
    found = [convert.parse_time(F.col(n).cast("string")) for n in CREATION_NAMES if n in source.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("long")


def entities(source: DataFrame, *, type: str, classes: list[str], key: Column, step: str, assign: dict[str, Column] | None = None, registry: Registry | None = None, raw: bool = False) -> DataFrame:
    """Entities of a source: its properties that the classes know, overridden by ``assign``.

    Null properties are absent ones. ``displayName`` falls back to ``name``, ``createdOn`` and ``active`` are derived where the source has
    what they come from. With ``raw`` the source row is kept as JSON under the name ``default``.
    """
    assign = dict(assign or {})
    known = (registry or default_registry()).property_names(classes)
    scalars = {f.name for f in source.schema if f.dataType.typeName() not in ("struct", "map", "array", "binary")}
    cols = {n: F.col(n) for n in source.columns if n in known and n in scalars and n != "tags"}
    if "createdOn" not in assign and any(n in source.columns for n in CREATION_NAMES):
        cols["createdOn"] = created_on(source)
    if "active" not in assign and "active" not in cols and "status" in source.columns:
        cols["active"] = active_flag(F.col("status"))
    cols |= assign
    if "displayName" not in cols and "name" in cols:
        cols["displayName"] = cols["name"]
    head = [key.cast("string").alias("_key"), F.lit(type).alias("_type"), F.array(*map(F.lit, classes)).alias("_class"), F.lit(step).alias("step_id")]
    if raw:
        head.append(F.array(F.struct(F.lit("default").alias("name"), F.to_json(F.struct(*source.columns)).alias("raw"))).alias("_raw"))
    return source.select(*head, *[c.alias(n) for n, c in cols.items()])


def relationships(pairs: DataFrame, cls: str, *, from_key: Column, to_key: Column, from_type: str, to_type: str, step: str, properties: dict[str, Column] | None = None, registry: Registry | None = None) -> DataFrame:
    """Direct relationships. Properties named ``_key``, ``_type``, ``_class`` or ``displayName`` override the computed ones."""
    if not (registry or default_registry()).is_relationship_class(cls):
        raise InvalidRelationshipClassError(cls)
    cols = {"_key": keys.relationship_key(from_key.cast("string"), F.lit(cls), to_key.cast("string")), "_type": F.lit(keys.relationship_type_of(cls, from_type, to_type)), "_class": F.lit(cls.upper()), "_fromEntityKey": from_key.cast("string"), "_toEntityKey": to_key.cast("string"), "displayName": F.lit(cls.upper())}
    for n, c in (properties or {}).items():
        cols[n] = F.coalesce(c, cols[n]) if n in cols else c
    return pairs.select(*[c.alias(n) for n, c in cols.items()], F.lit(step).alias("step_id"))


def mapped_relationships(rows: DataFrame, cls: str, *, source_key: Column, source_type: str, target: dict[str, Column], filter_keys: list[list[str]] = (("_type", "_key"),), direction: str = "FORWARD", skip: bool = False, step: str = "", properties: dict[str, Column] | None = None) -> DataFrame:
    """Relationships to targets that are found by properties.

    The key is ``source|class|target`` with the target's own key, or else one made of its filter properties; without either it is an error
    (MISSING_RELATIONSHIP_TO_KEY). ``properties`` are added; ``_key``, ``_type`` and ``_class`` among them take the place of the computed ones.
    """
    t = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), v.cast("string"))])
    t = F.map_filter(t, lambda k, v: v.isNotNull())
    sets = F.array(*[F.array(*map(F.lit, s)) for s in filter_keys])
    own = properties or {}
    to_key = F.coalesce(F.try_element_at(t, F.lit("_key")), keys.fallback_target_key(F.lit(direction), sets, t))
    to_type = F.coalesce(F.try_element_at(t, F.lit("_type")), F.lit("mapped_entity"))
    if "_key" not in own and not filter_keys:
        to_key = keys.first_present(F.try_element_at(t, F.lit("_key")), code=MissingTargetKeyError.code)
    mapping = F.struct(F.lit(direction).alias("direction"), source_key.cast("string").alias("source_key"), sets.alias("filter_keys"), t.alias("target"), F.lit(skip).alias("skip"))
    cols = {"_key": keys.relationship_key(source_key.cast("string"), F.lit(cls), to_key), "_type": keys.relationship_type(F.lit(cls), F.lit(source_type), to_type), "_class": F.lit(cls.upper()), "_mapping": mapping}
    for n, c in own.items():
        cols[n] = F.coalesce(c, cols[n]) if n in cols else c
    return rows.select(*[c.alias(n) for n, c in cols.items()], F.lit(step).alias("step_id"))


def raw_data(entities: DataFrame, name: str = "default", column: str = "_raw") -> Column:
    """JSON text of the first raw payload of a name, null without one."""
    return F.try_element_at(F.filter(column, lambda r: r["name"] == name), F.lit(1))["raw"]


def add_raw_data(entities: DataFrame, name: str, raw: Column, column: str = "_raw") -> DataFrame:
    """Append a payload; a name that is there already raises DUPLICATE_RAW_DATA_NAME in the row's task."""
    taken = F.exists(column, lambda r: r["name"] == name)
    more = F.array_append(F.col(column), F.struct(F.lit(name).alias("name"), raw.alias("raw")))
    return entities.withColumn(column, F.when(taken, F.raise_error(F.lit("DUPLICATE_RAW_DATA_NAME"))).otherwise(more))


def raw_names_unique(column: str = "_raw") -> Column:
    names = F.transform(column, lambda r: r["name"])
    return F.size(names) == F.size(F.array_distinct(names))
