"""Keys and types of relationships as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relationship_key(from_key: Column, cls: Column, to_key: Column) -> Column:
    """``from|class|to`` with the class in lower case; null if a part is null."""
    return F.concat(from_key, F.lit("|"), F.lower(cls), F.lit("|"), to_key)


def relationship_type(cls: Column, from_type: Column, to_type: Column) -> Column:
    """``from_class_to`` where ``to`` loses the leading tokens it shares with ``from``, but never its last one.

    Equal types of one token leave nothing of ``to``, and the result ends in ``_``.
    """
    a, b = F.split(from_type, "_"), F.split(to_type, "_")
    # position of the first token that differs
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: F.coalesce(F.try_element_at(a, i) == F.try_element_at(b, i), F.lit(False))), F.lit(False))
    shared = F.when(differs == 0, F.size(b)).otherwise(differs - 1).cast("int")
    shared = F.when((F.size(b) == 1) & (shared == 1), F.lit(1)).otherwise(F.least(shared, F.size(b) - 1))
    rest = F.array_join(F.slice(b, shared + 1, F.size(b)), "_")
    return F.concat(from_type, F.lit("_"), F.lower(cls), F.lit("_"), rest)


def relationship_type_of(cls: str, from_type: str, to_type: str) -> str:
    """:func:`relationship_type` for types known when the plan is made."""
    a, b = from_type.split("_"), to_type.split("_")
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    n = n if len(b) == 1 else min(n, len(b) - 1)
    return f"{from_type}_{cls.lower()}_{'_'.join(b[n:])}"


def fallback_target_key(direction: Column, filter_keys: Column, target: Column) -> Column:
    """``DIRECTION:k=v:...`` over all properties named in the filter-key sets, for targets without a key."""
    pairs = F.transform(F.flatten(filter_keys), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(target, k), F.lit(""))))
    return F.concat(direction, F.lit(":"), F.array_join(pairs, ":"))


def first_present(*columns: Column, code: str) -> Column:
    """The first non-null column; a row without any raises the error code."""
    return F.coalesce(*columns, F.raise_error(F.lit(code)))
