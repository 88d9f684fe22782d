"""Property-graph export: nodes and edges with labels and sanitised properties, upserts, removal of an instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_name, sanitize_value

RAW = "_rawData"


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.typeName()


def property_parameters(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A map of sanitised property names to text: raw data as quoted JSON, numbers and booleans as they are, all else sanitised text; nulls are left out."""
    pairs = []
    for c in columns or df.columns:
        kind, value = _kind(df, c), F.col(f"`{c}`")
        if c == RAW:
            name, text = F.lit(c), F.concat(F.lit('"'), value if kind == "string" else F.to_json(value), F.lit('"'))
        elif kind in ("struct", "map", "array"):
            text = F.array_join(value.cast("array<string>"), ",") if kind == "array" else F.to_json(value)
            name, text = sanitize_name(F.lit(c)), sanitize_value(text)
        else:
            text = value.cast("string")
            name, text = sanitize_name(F.lit(c)), sanitize_value(text) if kind == "string" else text
        pairs += [name, text]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def labels(type: Column, classes: Column) -> Column:
    """``:type:Class:Class`` of sanitised names; no classes, the type alone."""
    parts = F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.concat(F.lit(":"), sanitize_name(c)))
    return F.concat(F.lit(":"), sanitize_name(type), F.array_join(parts, ""))


def from_label(df: DataFrame) -> Column:
    """``:type`` of a relationship's start, empty if it has none."""
    return F.coalesce(F.concat(F.lit(":"), F.col("_fromType")), F.lit("")) if "_fromType" in df.columns else F.lit("")


def to_label(df: DataFrame) -> Column:
    """``:type`` of a relationship's end: its own, else its mapping's target type, else empty."""
    found = [F.col("_toType")] if "_toType" in df.columns else []
    if "_mapping" in df.columns:
        found.append(F.try_element_at("_mapping.target", F.lit("_type")))
    return F.coalesce(*[F.concat(F.lit(":"), c) for c in found], F.lit(""))


def nodes(entities: DataFrame, instance: str, columns: list[str] | None = None) -> DataFrame:
    """(_key, instance, labels, properties) of entities."""
    return entities.select(sanitize_value(F.col("_key")).alias("_key"), F.lit(instance).alias("instance"), labels(F.col("_type"), F.col("_class")).alias("labels"), property_parameters(entities, columns).alias("properties"))


def edges(relationships: DataFrame, instance: str, columns: list[str]) -> DataFrame:
    """(_key, start_key, end_key, start_label, end_label, label, instance, properties). A mapped relationship starts at its source and ends at what its key has besides the source's."""
    start, end = (F.col(c) if c in relationships.columns else F.lit(None).cast("string") for c in ("_fromEntityKey", "_toEntityKey"))
    if "_mapping" in relationships.columns:
        mapped = F.col("_mapping").isNotNull()
        start = F.when(mapped, F.col("_mapping.source_key")).otherwise(start)
        end = F.when(mapped, _target_key()).otherwise(end)
    return relationships.select(F.col("_key"), sanitize_value(start).alias("start_key"), sanitize_value(end).alias("end_key"), from_label(relationships).alias("start_label"), to_label(relationships).alias("end_label"), F.concat(F.lit(":"), sanitize_name(F.col("_class"))).alias("label"), F.lit(instance).alias("instance"), property_parameters(relationships, columns).alias("properties"))


def _target_key() -> Column:
    at = F.instr("_key", F.col("_mapping.source_key"))
    return F.when(at > 0, F.concat(F.substr("_key", F.lit(1), at - 1), F.substr("_key", at + F.length("_mapping.source_key")))).otherwise(F.col("_key"))


def created_targets(mapped: DataFrame, instance: str) -> DataFrame:
    """Nodes of the targets of mapped relationships that ask for them, one for each key."""
    t = mapped.where(~F.col("_mapping.skip")).select(sanitize_value(_target_key()).alias("_key"), F.col("_mapping.target").alias("t"))
    named = F.map_from_entries(F.transform(F.map_entries("t"), lambda e: F.struct(sanitize_name(e["key"]).alias("key"), sanitize_value(e["value"]).alias("value"))))
    label = labels(F.coalesce(F.col("t")["_type"], F.lit("mapped_entity")), F.split(F.col("t")["_class"], ", ?"))
    return t.select("_key", F.lit(instance).alias("instance"), label.alias("labels"), named.alias("properties")).dropDuplicates(["_key"])


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("_key", "instance")) -> DataFrame:
    """What a merge leaves: rows of ``new``, and those of ``old`` whose keys it lacks; properties of both, the new ones over the old."""
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    j = o.join(n, list(keys), "full_outer")
    out = []
    for c in (c for c in new.columns if c not in keys):
        if c == "properties":
            out.append(F.map_concat(F.map_filter(F.coalesce("_old.properties", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("_new.properties", k), F.lit(False))), F.coalesce("_new.properties", F.create_map().cast("map<string,string>"))).alias(c))
        else:
            out.append(F.coalesce(f"_new.{c}", f"_old.{c}").alias(c))
    return j.select(*keys, *out)


def wipe_instance(nodes: DataFrame, edges: DataFrame, instance: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of an instance; an edge goes with either of its nodes."""
    other = ~F.col("instance").eqNullSafe(instance)
    gone = nodes.where(~other).select(F.col("_key").alias("_gone"))
    left = edges.where(other).join(gone, F.col("start_key") == F.col("_gone"), "left_anti").join(gone, F.col("end_key") == F.col("_gone"), "left_anti")
    return nodes.where(other), left
