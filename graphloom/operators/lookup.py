"""Lookups, duplicates, differences and target resolution, all as joins and aggregations on keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model.errors import DuplicateKeyError, GraphError


def find_entity(wanted: DataFrame, key: str, entities: DataFrame, normalise=lambda k: k) -> DataFrame:
    """``wanted`` with the columns of the entity of its key (``found_`` before their names), null where there is none."""
    e = entities.select(normalise(F.col("_key")).alias("_n"), *[F.col(c).alias(f"found_{c}") for c in entities.columns])
    return wanted.withColumn("_n", normalise(F.col(key))).join(e, "_n", "left").drop("_n")


def has_key(wanted: DataFrame, key: str, objects: DataFrame, normalise=lambda k: k, negate: bool = False) -> DataFrame:
    """The rows whose key is (or, negated, is not) among the keys of entities and relationships."""
    known = objects.select(normalise(F.col("_key")).alias("_n"))
    return wanted.withColumn("_n", normalise(F.col(key))).join(known, "_n", "left_anti" if negate else "left_semi").drop("_n")


def duplicate_keys(objects: DataFrame, normalise=lambda k: k) -> DataFrame:
    """(key, count) of the keys registered more than once; counts combine before the shuffle."""
    return objects.groupBy(normalise(F.col("_key")).alias("key")).agg(F.count("*").alias("count")).where("count > 1")


def first_and_later(objects: DataFrame, order: list[str], normalise=lambda k: k) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, later rows), by an explicit order."""
    w = W.partitionBy(normalise(F.col("_key"))).orderBy(*order)
    r = objects.withColumn("_rn", F.row_number().over(w))
    return r.where("_rn = 1").drop("_rn"), r.where("_rn > 1").drop("_rn")


def register_keys(objects: DataFrame, normalise=lambda k: k) -> DataFrame:
    """The objects, once their keys are known to be distinct; else raises DUPLICATE_KEY_DETECTED with some of the keys. Runs the check."""
    if again := duplicate_keys(objects, normalise).orderBy("key").limit(5).collect():
        raise DuplicateKeyError(f"duplicate keys, such as {[r['key'] for r in again]}")
    return objects


def duplicate_report(objects: DataFrame, order: list[str], properties: list[str], raw: str | None = None) -> DataFrame:
    """Each later row of a key against its first: whether properties and raw data are equal, and which properties differ.

    Rows tied in ``order`` go by their other columns, so exact copies are reported too. Keys are counted first, without their rows; only rows of repeated
    keys are sorted.
    """
    again = objects.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    values = [*order, *properties, *([raw] if raw else [])]
    by = W.partitionBy("_key").orderBy(*dict.fromkeys(values))
    d = objects.join(again, "_key", "left_semi").withColumn("_o", F.first(F.struct(*dict.fromkeys(values))).over(by)).withColumn("_rn", F.row_number().over(by)).where("_rn > 1")
    differs = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"_o.{p}")), F.lit(p)) for p in properties]))
    same_raw = F.col(raw).eqNullSafe(F.col(f"_o.{raw}")) if raw else F.lit(True)
    return d.select("_key", *[F.col(c).alias(f"duplicate_{c}") for c in order], *[F.col(f"_o.{c}").alias(f"original_{c}") for c in order], (F.size(differs) == 0).alias("properties_match"), same_raw.alias("raw_data_match"), differs.alias("differing"))


def property_diff(pairs: DataFrame, properties: list[str], left: str = "a", right: str = "b", keep: list[str] = ()) -> DataFrame:
    """(keep, path, kind) per differing property of two structs, into nested structs by dotted paths.

    A null is a missing property. Kinds: missing_in_original, missing_in_duplicate, type_mismatch (the sides' types differ), array_values_mismatch, value_mismatch.
    """
    sides = [pairs.schema[x].dataType for x in (left, right)]
    rules = []

    def compare(path: str, a, b, one, two):
        missing = F.when(a.isNull() & b.isNull(), F.lit(None).cast("string")).when(a.isNull(), "missing_in_original").when(b.isNull(), "missing_in_duplicate")
        kinds = [_kind(x) for x in (one, two)]
        if kinds == ["struct", "struct"]:
            rules.append(F.struct(F.lit(path).alias("path"), missing.alias("kind")))
            there = a.isNotNull() & b.isNotNull()
            for f in dict.fromkeys([*one.names, *two.names]):
                inner = [F.when(there, x[f]) if f in t.names else F.lit(None) for x, t in ((a, one), (b, two))]
                compare(f"{path}.{f}", *inner, *[t[f].dataType if f in t.names else None for t in (one, two)])
            return
        if None in kinds or kinds[0] == kinds[1]:
            found = missing if None in kinds else missing.when(~a.eqNullSafe(b), "array_values_mismatch" if kinds[0] == "array" else "value_mismatch")
        else:
            found = missing.otherwise("type_mismatch")
        rules.append(F.struct(F.lit(path).alias("path"), found.alias("kind")))

    for p in properties:
        compare(p, *[F.col(f"{x}.{p}") if p in t.names else F.lit(None) for x, t in zip((left, right), sides, strict=True)], *[t[p].dataType if p in t.names else None for t in sides])
    return pairs.select(*keep, F.explode(F.array(*rules)).alias("d")).select(*keep, "d.path", "d.kind").where("kind IS NOT NULL")


def _kind(t) -> str | None:
    """Numbers of all widths are one kind."""
    name = t.typeName() if t else None
    return "number" if name in ("byte", "short", "integer", "long", "float", "double", "decimal") else name


def snapshot_diff(old: DataFrame, new: DataFrame, properties: list[str], key: str = "_key") -> DataFrame:
    """(key, change): added, removed, changed or same, by a full outer join on the key."""
    o = old.select(F.col(key), F.struct(*properties).alias("o"))
    n = new.select(F.col(key), F.struct(*properties).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def dangling_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Direct relationships with an end that no entity has, and which end that is: one pass over relationships, one shuffle of their ends."""
    known = entities.select(F.col("_key").alias("_k"))
    names = relationships.columns
    ends = F.array(F.struct(F.lit("from").alias("missing"), F.col("_fromEntityKey").alias("_k")), F.struct(F.lit("to").alias("missing"), F.col("_toEntityKey").alias("_k")))
    return relationships.withColumn("_e", F.explode(ends)).select(*names, "_e.missing", "_e._k").join(known, "_k", "left_anti").select(*names, "missing")


#: Different filter-key sets of one resolution, which are metadata.
MAX_SETS = 1000


def resolve_targets(mapped: DataFrame, entities: DataFrame, properties: list[str], order: str = "_key") -> DataFrame:
    """The target entity of each mapped relationship, null if none matches.

    Filter-key sets are tried in order; the first entity, by ``order``, that has all of a set's values wins. ``_class`` in a set asks for entities
    that have all classes of the target (commas between them). Properties that the target lacks are not compared; a property that
    ``properties`` does not name is had by no entity. For each distinct set, entities and targets are joined on one composite value, and
    before the join each value's entities are reduced to the first of each combination of classes: rows grow with entities and relationships, never with their pairs.
    """
    target = F.col("_mapping.target")
    sets = mapped.select("_key", target.alias("t"), F.posexplode("_mapping.filter_keys").alias("set_no", "names"))
    sets = sets.withColumn("names", F.array_sort(F.array_distinct(F.filter("names", lambda n: F.col("t")[n].isNotNull()))))
    sets = sets.withColumn("wanted", F.when(F.array_contains("names", "_class"), F.array_sort(F.split(F.col("t")["_class"], ", ?")))).withColumn("names", F.array_remove("names", "_class"))
    need = sets.withColumn("value", F.to_json(F.transform("names", lambda n: F.col("t")[n]))).select("_key", "set_no", F.to_json("names").alias("names"), "value", F.coalesce("wanted", F.array().cast("array<string>")).alias("wanted"))
    kinds = [r["names"] for r in need.select("names").distinct().limit(MAX_SETS + 1).collect()]
    if len(kinds) > MAX_SETS:
        raise GraphError(f"more than {MAX_SETS} different filter-key sets")
    having = [json.loads(k) for k in kinds]
    having = [n for n in having if set(n) <= {*properties, *entities.columns}]
    none = F.lit(None).cast("string")
    of_set = [F.struct(F.lit(json.dumps(n, separators=(",", ":"))).alias("names"), F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in n], F.lit(True)), lambda x: x), F.to_json(F.array(*[F.col(c).cast("string") for c in n]) if n else F.array().cast("array<string>"))).alias("value")) for n in having] or [F.struct(none.alias("names"), none.alias("value"))]
    classes = F.array_sort(F.col("_class")) if "_class" in entities.columns else F.array().cast("array<string>")
    have = entities.select(F.col("_key").alias("entity_key"), F.col(order).alias("_order"), classes.alias("classes"), F.explode(F.array(*of_set)).alias("s")).select("entity_key", "_order", "classes", "s.names", "s.value").where("value IS NOT NULL")
    have = have.groupBy("names", "value", "classes").agg(F.min(F.struct("_order", "entity_key")).alias("e"))
    asked = need.select("names", "value", "wanted").distinct()
    first = asked.join(have, ["names", "value"]).where(F.size(F.array_except("wanted", "classes")) == 0).groupBy("names", "value", "wanted").agg(F.min("e").alias("e"))
    best = need.join(first, ["names", "value", "wanted"]).groupBy("_key").agg(F.min(F.struct("set_no", "e")).alias("b")).select("_key", F.col("b.e.entity_key").alias("target_key"))
    return mapped.join(best, "_key", "left")


def resolved_edges(resolved: DataFrame) -> DataFrame:
    """(key, from, to, placeholder): oriented by direction; a stub key stands for a target that was not found."""
    target = F.coalesce("target_key", F.concat(F.lit("stub:"), F.col("_mapping.target")[F.lit("_type")], F.lit(":"), F.substring(F.sha2(F.to_json("_mapping.target"), 256), 1, 16)))
    back = F.col("_mapping.direction") == "REVERSE"
    return resolved.select("_key", F.when(back, target).otherwise(F.col("_mapping.source_key")).alias("from_key"), F.when(back, F.col("_mapping.source_key")).otherwise(target).alias("to_key"), F.col("target_key").isNull().alias("placeholder"))


def latest_wins(objects: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``; what an upsert leaves."""
    cols = [c for c in objects.columns if c not in keys]
    return objects.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in cols])


def first_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First-wins distinct over a composite key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in cols])


def split_mapped(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct, mapped) relationships; mapped ones have a mapping."""
    mapped = F.col("_mapping").isNotNull()
    return relationships.where(~mapped), relationships.where(mapped)


def indexed(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Objects whose step and type are not declared as unindexed: ``metadata`` has (step_id, _type, indexed), where a null or missing row means indexed."""
    off = metadata.where("NOT indexed").select("step_id", "_type").distinct()
    return objects.join(F.broadcast(off), ["step_id", "_type"], "left_anti")


def placeholders(resolved: DataFrame) -> DataFrame:
    """One row per distinct target that was not found: (target: its filter properties alone, used: relationships that aim at it)."""
    t = resolved.where("target_key IS NULL").select(F.col("_mapping.target").alias("t"), F.array_distinct(F.flatten("_mapping.filter_keys")).alias("names"))
    trimmed = F.array_sort(F.filter(F.transform("names", lambda n: F.struct(n.alias("name"), F.try_element_at("t", n).alias("value"))), lambda x: x["value"].isNotNull()))
    return t.groupBy(trimmed.alias("pairs")).agg(F.count("*").alias("used")).select(F.map_from_entries("pairs").alias("target"), "used")


def target_counts(wanted: DataFrame, wanted_on: str, entities: DataFrame, entity_on: str) -> DataFrame:
    """The rows of ``wanted`` with the number of entities (``targets``) that have their value; counted per value before the join."""
    per = entities.groupBy(F.col(entity_on).alias("_v")).agg(F.count("*").alias("targets"))
    return wanted.join(per, F.col(wanted_on) == F.col("_v"), "left").drop("_v").withColumn("targets", F.coalesce("targets", F.lit(0)))


def missing_sources(mapped: DataFrame, entities: DataFrame) -> DataFrame:
    """(_key) of the sources that mapped relationships name and no entity has, each once."""
    return has_key(mapped.select(F.col("_mapping.source_key").alias("_key")).distinct(), "_key", entities, negate=True)
