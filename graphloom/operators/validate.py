"""Validation rules compiled from the registry to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_format
from ..model.registry import Property, Registry, default_registry


def errors(df: DataFrame, classes: list[str], registry: Registry | None = None, extension: dict[str, Property] | None = None) -> Column:
    """Array of (property, validation, message): required properties that are null, values outside an enum or format."""
    schema = (registry or default_registry()).merged(classes, extension)
    rules = []
    bad = lambda p, kind, msg: F.struct(F.lit(p).alias("property"), F.lit(kind).alias("validation"), F.lit(msg).alias("message"))
    for p in schema.required:
        rules.append(F.when(F.col(p).isNull(), bad(p, "required", f"must have property {p}")) if p in df.columns else bad(p, "required", f"must have property {p}"))
    for p, rule in sorted(schema.properties.items()):
        if p in df.columns and rule.enum:
            rules.append(F.when(~F.col(p).isin(*rule.enum), bad(p, "enum", "must be one of the allowed values")))
        if p in df.columns and rule.format:
            rules.append(F.when(~has_format(F.col(p).cast("string"), rule.format), bad(p, "format", f"must match format {rule.format}")))
    return F.array_compact(F.array(*rules)) if rules else F.array().cast("array<struct<property:string,validation:string,message:string>>")


#: Spark types that a property of a registry type may have.
_FITS = {"string": ("string",), "number": ("byte", "short", "integer", "long", "float", "double", "decimal"), "integer": ("byte", "short", "integer", "long"), "boolean": ("boolean",), "array": ("array",)}

_NO_ERRORS = "array<struct<schema:string,property:string,validation:string,message:string>>"


def assertion() -> Column:
    """An entity needs ``_type`` and ``_class``: the first of these errors, or null."""
    error = lambda p: F.struct(F.lit(None).cast("string").alias("schema"), F.lit(p).alias("property"), F.lit("required").alias("validation"), F.lit(f"entity has no {p}").alias("message"))
    return F.when(F.col("_type").isNull(), error("_type")).when(F.col("_class").isNull() | (F.size("_class") == 0), error("_class"))


def validate_entities(df: DataFrame, registry: Registry | None = None, *, types: dict[str, tuple[list[str], dict[str, Property]]] | None = None, force: bool = False) -> DataFrame:
    """(_key, valid, errors, skipped) of entities of any types and classes.

    ``types`` names the types that have a schema of their own: (classes, further properties). Such a schema holds its classes' rules, so the classes are
    skipped (``type-already-validated``) unless ``force``; types and classes without a schema are skipped too (``not-found``). Rules are compiled once for each
    type and class known, and a row is judged by those that are its own. An error names its schema, property, rule and message.
    """
    known, types = registry or default_registry(), types or {}

    def of(schema: str, classes: list[str], extension=None) -> Column:
        found = errors(df, classes, known, extension)
        wrong = []
        for p, rule in sorted(known.merged(classes, extension).properties.items()):
            if p in df.columns and df.schema[p].dataType.typeName() not in (*_FITS.get(rule.type, ()), "void"):
                wrong.append(F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("property"), F.lit("type").alias("validation"), F.lit(f"must be {rule.type}").alias("message"))))
        found = F.concat(found, F.array_compact(F.array(*wrong))) if wrong else found
        return F.transform(found, lambda e: F.struct(F.lit(f"#{schema}").alias("schema"), e["property"].alias("property"), e["validation"].alias("validation"), e["message"].alias("message")))

    none = F.array().cast(_NO_ERRORS)
    typed = F.col("_type").isin(list(types)) if types else F.lit(False)
    found = [F.when(F.col("_type") == t, of(t, *spec)).otherwise(none) for t, spec in types.items()]
    by_class = [F.when(F.array_contains("_class", c), of(c, [c])).otherwise(none) for c in known.schemas]
    by_class = F.flatten(F.array(*by_class)) if by_class else none
    judged = F.concat(*found, by_class if force else F.when(typed, none).otherwise(by_class))
    first = assertion()
    all_errors = F.when(first.isNotNull(), F.array(first)).otherwise(judged)
    skip = lambda name, why: F.struct(F.concat(F.lit("#"), name).alias("schema"), F.lit(why).alias("reason"))
    no_type = F.when(typed, F.array().cast("array<struct<schema:string,reason:string>>")).otherwise(F.array(skip(F.col("_type"), "not-found")))
    absent = F.transform(F.filter("_class", lambda c: ~c.isin(list(known.schemas))), lambda c: skip(c, "not-found"))
    by_type = F.transform("_class", lambda c: skip(c, "type-already-validated"))
    skipped = F.when(first.isNotNull(), F.array().cast("array<struct<schema:string,reason:string>>")).otherwise(F.concat(no_type, absent if force else F.when(typed, by_type).otherwise(absent)))
    return df.select("_key", all_errors.alias("errors"), skipped.alias("skipped")).select("_key", (F.size("errors") == 0).alias("valid"), "errors", "skipped")


def conformance(df: DataFrame, classes: list[str], registry: Registry | None = None) -> DataFrame:
    """(key, property, validation) of every violation."""
    return df.select("_key", F.explode(errors(df, classes, registry)).alias("e")).select("_key", "e.property", "e.validation")


def only_scalars(df: DataFrame) -> list[str]:
    """Names of relationship properties that are not scalars; checked on the schema."""
    return [f.name for f in df.schema if f.dataType.typeName() in ("struct", "map", "array") and not f.name.startswith("_")]
