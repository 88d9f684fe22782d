"""Conversion of provider values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that mean a time: a word ending in Time, _time, On, _on, At, _at, Date, _date (fixed pattern).
TIME_NAME = r"^\w+((T|_t)ime|(O|_o)n|(A|_a)t|(D|_d)ate)$"


def parse_string_value(s: Column) -> Column:
    """Tagged scalar (kind, s, d, b): case-insensitive booleans, unsigned integers and decimals; all else stays text."""
    low = F.lower(s)
    is_bool = low.isin("true", "false")
    # fixed patterns of numbers
    is_number = s.rlike(r"^\d+$") | s.rlike(r"^\d+\.\d+$")
    kind = F.when(s.isNull(), F.lit(None).cast("string")).when(is_bool, "boolean").when(is_number, "number").otherwise("string")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", s).alias("s"),
        F.when(kind == "number", s.try_cast("double")).alias("d"),
        F.when(kind == "boolean", low == "true").alias("b"),
    )


def is_time_property(name: Column) -> Column:
    return name.rlike(TIME_NAME)


#: Forms of dates besides ISO ones that are read, without the day of the week (fixed values).
DATE_FORMS = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMM d yyyy", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy")


def parse_time(value: Column, precision: str | None = None) -> Column:
    """Epoch milliseconds of a text, fractions cut. A number needs ``precision`` (``sec`` or ``ms``) and is an error without; dates are ISO or
    of ``DATE_FORMS``; what cannot be read is null, as is an empty text.
    """
    text = F.when(F.trim(value) != "", F.trim(value))
    number = text.try_cast("double")
    if precision:
        from_number = F.floor(number * (1000 if precision == "sec" else 1)).cast("long")
    else:
        from_number = F.raise_error(F.lit("a number needs a precision")).cast("long")
    plain = F.regexp_replace(text, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    dates = [F.try_to_timestamp(text), *[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMS]]
    return F.when(number.isNotNull(), from_number).otherwise(F.unix_millis(F.coalesce(*dates)))


def camel_case(name: Column) -> Column:
    """Words joined in camel case: parted by other than letters and digits, by a change to upper case, before the last of several capitals and around digits.

    Apostrophes part nothing. Letters keep their accents.
    """
    parted = F.regexp_replace(name, "['\u2019]", "")
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\d)", r"(\d)(\p{L})"):
        parted = F.regexp_replace(parted, pattern, "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(parted, r"[^\p{L}\d]+", " ")), " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, F.initcap), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def convert_properties(properties: Column, prefix: str | None = None) -> Column:
    """A map of text scalars with camel-case names (behind ``prefix.``); null values go, the later of equal names stays."""
    pre = F.lit(f"{prefix}." if prefix else "")
    entries = F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.concat(pre, camel_case(e["key"])).alias("key"), e["value"].alias("value"))))


def camel_name(name: str) -> str:
    """:func:`camel_case` of a name known when the plan is made."""
    s = re.sub("['\u2019]", "", name)
    words = re.findall(r"[^\W\d_]*?[^\W\d_](?=[A-Z][a-z])|(?:[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+)|\d+", s)
    return "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(words))


def convert_columns(df: DataFrame, *, prefix: str | None = None, parse_string=False, parse_time_names=False, stringify_array=False, stringify_object=False) -> list[Column]:
    """The columns of a frame as properties of camel-case names (behind ``prefix.``).

    Scalars stay; texts become tagged scalars with ``parse_string``, else times with ``parse_time_names`` where the name means one and every text can be read
    (texts that are no time stay as they are, as text). Arrays of scalars stay; arrays are null where their first entry is null or missing, and JSON text
    with ``stringify_array``; structs, maps and arrays of them are JSON text with ``stringify_object`` and else left out.
    """
    out = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        name = f"{prefix}.{camel_name(f.name)}" if prefix else camel_name(f.name)
        if kind == "string" and parse_string:
            c = parse_string_value(c)
        elif kind == "string" and parse_time_names and re.search(TIME_NAME, f.name):
            c = F.coalesce(F.unix_millis(F.try_to_timestamp(c)).cast("string"), c)
        elif kind == "array":
            nested = f.dataType.elementType.typeName() in ("struct", "map", "array")
            if stringify_array:
                c = F.to_json(c)
            elif nested:
                if not stringify_object:
                    continue
                c = F.transform(c, F.to_json)
            c = F.when(F.try_element_at(F.col(f"`{f.name}`"), F.lit(1)).isNotNull(), c)
        elif kind in ("struct", "map"):
            if not stringify_object:
                continue
            c = F.to_json(c)
        out.append(c.alias(name))
    return out


def name_value_pairs(pairs: Column, prefix: str | None = None, *, fields: tuple[str, str] = ("name", "value"), parse: bool = False) -> Column:
    """Array of (name, value) to a map of camel-case names; empty names and values are skipped and later ones win (map policy LAST_WIN).

    ``fields`` names the two fields, as providers do; with ``parse`` values are tagged scalars.
    """
    pre, (n, v) = F.lit(f"{prefix}." if prefix else ""), fields
    kept = F.filter(pairs, lambda p: (F.coalesce(p[n], F.lit("")) != "") & (F.coalesce(p[v], F.lit("")) != ""))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(F.concat(pre, camel_case(p[n])).alias("key"), (parse_string_value(p[v]) if parse else p[v]).alias("value"))))


def json_text(s: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(s.alias("x"))), r'^\{"x":', ""), r"\}$", "")


def sha256_base64(json: Column) -> Column:
    """Base64 of the SHA-256 of JSON text; a bare string is hashed with its quotes, so pass :func:`json_text` of it."""
    return F.base64(F.unhex(F.sha2(json, 256)))


def truncate_value(s: Column, most: int = 4096) -> Column:
    """At most ``most`` characters (fixed value): longer texts end in three dots."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def object_size(*columns: str) -> Column:
    """UTF-8 bytes of a row's JSON text; null properties are left out."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("long")


def property_sizes(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep, prop, bytes, rank): JSON bytes of each property of each row; null ones are left out. ``rank`` is its place among ``columns``."""
    def size(c: str) -> Column:
        kind, value = df.schema[c].dataType.typeName(), F.col(f"`{c}`")
        text = json_text(value) if kind == "string" else F.to_json(value) if kind in ("struct", "map", "array") else value.cast("string")
        return F.octet_length(text).cast("long")

    sizes = F.array(*[F.struct(F.lit(c).alias("prop"), size(c).alias("bytes"), F.lit(i).alias("rank")) for i, c in enumerate(columns)])
    return df.select(*keep, F.explode(sizes).alias("x")).select(*keep, "x.prop", "x.bytes", "x.rank").where("bytes IS NOT NULL")


def largest_property(sizes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, prop, bytes) of each row's largest property, the first of equals, from :func:`property_sizes`."""
    return sizes.groupBy(*keep).agg(F.max_by("prop", F.struct("bytes", -F.col("rank"))).alias("prop"), F.max("bytes").alias("bytes"))


def trim_strings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All texts without blanks at their ends, also inside structs and arrays of any depth; columns of ``keep`` stay as they are."""

    def trimmed(c: Column, t) -> Column:
        kind = t.typeName()
        if kind == "string":
            return F.trim(c)
        if kind == "struct":
            return F.when(c.isNotNull(), F.struct(*[trimmed(c[f.name], f.dataType).alias(f.name) for f in t]))
        if kind == "array":
            return F.transform(c, lambda x: trimmed(x, t.elementType))
        return c

    return df.select(*[F.col(f"`{f.name}`") if f.name in keep else trimmed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
