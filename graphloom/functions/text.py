"""Network, tag and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET, _HEX = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])", "[0-9a-fA-F]{1,4}"
_V4 = rf"({_OCTET}\.){{3}}{_OCTET}"
_V6 = "|".join([rf"({_HEX}:){{7}}{_HEX}", rf"({_HEX}:){{1,7}}:", *[rf"({_HEX}:){{{i}}}(:{_HEX}){{1,{7 - i}}}" for i in range(1, 7)], rf":((:{_HEX}){{1,7}}|:)", rf"::([fF]{{4}}(:0{{1,4}})?:)?{_V4}", rf"({_HEX}:){{6}}{_V4}", rf"({_HEX}:){{1,4}}:{_V4}"])
_BITS4, _BITS6 = "(3[0-2]|[12]?[0-9])", "(12[0-8]|1[01][0-9]|[1-9]?[0-9])"
#: Patterns of the string formats. A network of IPv6 is written out, ends in ``::`` or is ``::``; eight or fewer groups without a size count too (fixed rule).
FORMATS = {
    "asn": r"^AS\d{2,6}$",
    "ip": rf"^({_V4}|{_V6})$",
    "ipCidr": rf"^({_V4}/{_BITS4}|(({_HEX}:){{7}}{_HEX}|({_HEX}:){{1,7}}:|::)/{_BITS6}|({_HEX}:){{1,7}}{_HEX})$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$",
}
#: Tags that become properties of their own (fixed values).
COMMON_TAGS = ("classification", "owner", "email")


def has_format(s: Column, name: str) -> Column:
    return s.rlike(FORMATS[name])


def is_host(ip: Column) -> Column:
    """Single addresses: /32, or /128 of IPv6. (An IPv6 /32 network counts as one too.)"""
    return (ip.contains(":") & ip.endswith("/128")) | ip.endswith("/32")


def is_internet(ip: Column) -> Column:
    return ip.startswith("0.0.0.0") | (ip == "::/0")


def is_loopback(ip: Column) -> Column:
    return ip.startswith("127.0.0.1") | (ip == "::1/128")


def is_public(ip: Column) -> Column:
    return ~ip.rlike(r"^(127\.|10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)")


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?$")


def starts_with_number(s: Column) -> Column:
    return s.rlike("^[0-9]")


#: Characters that a property name cannot have (fixed set).
PUNCTUATION = r"[\s!@#$%^&*()\-=+\\|'\";:/?.,><`~\[\]{}]"


def sanitize_name(name: Column) -> Column:
    """A property name for graph stores: ``n`` before a leading digit, punctuation and blanks to underscores; letters of any alphabet stay."""
    safe = F.regexp_replace(name, PUNCTUATION, "_")
    return F.when(starts_with_number(name), F.concat(F.lit("n"), safe)).otherwise(safe)


def sanitize_value(value: Column) -> Column:
    """Backslashes before a double quote become one."""
    return F.regexp_replace(value, r'\\*"', r'\\"')


def sanitize_content(text: Column) -> Column:
    r"""Written ``\n`` and ``\r`` get another backslash."""
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\\\\n")), F.lit("\\r"), F.lit("\\\\r"))


def split_tags(tags: Column) -> Column:
    """Tags in a text, parted by commas if it has any, else by blanks; trimmed, without empty ones."""
    parts = F.when(tags.contains(","), F.split(tags, ",")).otherwise(F.split(tags, " "))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def label_tags(tags: Column) -> Column:
    """Names of the tags that are labels: value ``true`` or empty; a null value is no tag."""
    return F.map_keys(F.map_filter(tags, lambda k, v: F.lower(v).isin("", "true")))


def tag_properties(tags: Column) -> Column:
    """``tag.<name>`` to value for every tag that has one."""
    return F.transform_keys(F.map_filter(tags, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("tag."), k))


def tag_name(tags: Column) -> Column:
    """The value of the last tag called ``name`` in any case, unless empty: a display name, and a name where there is none."""
    found = F.map_values(F.map_filter(tags, lambda k, v: (F.lower(k) == "name") & (v != "")))
    return F.try_element_at(found, F.lit(-1))


def key_value_tags(pairs: Column, fields: tuple[str, str] = ("Key", "Value")) -> Column:
    """A tag map from an array of (key, value); pairs without a key or with a null value go, later ones win."""
    k, v = fields
    kept = F.filter(pairs, lambda p: (F.coalesce(p[k], F.lit("")) != "") & p[v].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p[k].alias("key"), p[v].alias("value"))))


def common_tag(tags: Column, name: str) -> Column:
    """The value of a common tag, whatever the case of its name, in lower case."""
    found = F.map_values(F.map_filter(tags, lambda k, v: F.lower(k) == name.lower()))
    return F.lower(F.try_element_at(found, F.lit(1)))


def class_match(classes: Column, wanted: Column) -> Column:
    """No wanted classes: true. No classes: false. Else whether all wanted ones are there."""
    return F.when(wanted.isNull(), True).when(classes.isNull(), False).otherwise(F.size(F.array_except(wanted, classes)) == 0)


def wrapped_json(properties: Column) -> Column:
    """``key: json`` lines of a map."""
    return F.array_join(F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
