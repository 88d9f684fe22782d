"""Class schemas: inheritance, property lists and merging. Lives on the driver; compiled to columns at plan time."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import NoSchemaError, SchemaReferenceError

_SPARK = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
#: Relationship classes known by default; a registry may hold others.
RELATIONSHIP_CLASSES = frozenset({"ALLOWS", "ASSIGNED", "CONTAINS", "HAS", "IS", "OWNS"})


@dataclass(frozen=True)
class Property:
    """Type and constraints of one property."""

    type: str = "string"
    enum: tuple[str, ...] = ()
    format: str | None = None
    exclude: bool = False


@dataclass(frozen=True)
class ClassSchema:
    """A class: its parents, own properties and required ones."""

    name: str
    parents: tuple[str, ...] = ()
    properties: dict[str, Property] = field(default_factory=dict)
    required: tuple[str, ...] = ()


_TEXT, _NUMBER, _FLAG, _LIST = Property(), Property("number"), Property("boolean"), Property("array")


class Registry:
    """Schemas by id. Adding a schema under a known id replaces it."""

    def __init__(self, schemas: list[ClassSchema] = (), relationship_classes=RELATIONSHIP_CLASSES):
        self.schemas: dict[str, ClassSchema] = {}
        self.relationship_classes = frozenset(relationship_classes)
        self.add(*schemas)

    def add(self, *schemas: ClassSchema) -> "Registry":
        self.schemas.update({s.name: s for s in schemas})
        return self

    def get(self, name: str) -> ClassSchema:
        if name not in self.schemas:
            raise NoSchemaError(f"no schema for class {name}")
        return self.schemas[name]

    def lineage(self, name: str) -> list[ClassSchema]:
        """The class and its ancestors, nearest first, each once."""
        out, queue = [], [self.get(name)]
        while queue:
            s = queue.pop(0)
            if s in out:
                continue
            out.append(s)
            for p in s.parents:
                if p not in self.schemas:
                    raise SchemaReferenceError(f"{s.name} refers to {p}")
                queue.append(self.schemas[p])
        return out

    def merged(self, classes: list[str], extension: dict[str, Property] | None = None) -> ClassSchema:
        """Properties and requirements of several classes; nearer definitions win, enums unite, excluded ones go."""
        properties: dict[str, Property] = {}
        required: dict[str, None] = {}
        for c in classes:
            for s in self.lineage(c):
                for k, p in s.properties.items():
                    old = properties.get(k)
                    if old is None:
                        properties[k] = p
                    elif old.enum and p.enum:
                        properties[k] = Property(old.type, tuple(dict.fromkeys(old.enum + p.enum)), old.format or p.format, old.exclude or p.exclude)
                required.update(dict.fromkeys(s.required))
        properties.update(extension or {})
        gone = {k for k, p in properties.items() if p.exclude}
        return ClassSchema("+".join(classes), (), {k: p for k, p in properties.items() if k not in gone}, tuple(k for k in required if k not in gone))

    def property_names(self, classes: list[str]) -> list[str]:
        """Sorted names of all properties that the classes may have."""
        return sorted(self.merged(classes).properties)

    def struct(self, classes: list[str], extension: dict[str, Property] | None = None) -> T.StructType:
        m = self.merged(classes, extension)
        return T.StructType([T.StructField(k, _SPARK[m.properties[k].type], k not in m.required) for k in sorted(m.properties)])

    def is_relationship_class(self, name: str) -> bool:
        return name.upper() in self.relationship_classes


def dedup_types(schema: dict) -> dict:
    """A JSON schema with each type, required name and enum value listed once, in order."""
    once = lambda x: list(dict.fromkeys(x)) if isinstance(x, list) else x
    out = dict(schema)
    if "required" in out:
        out["required"] = once(out["required"])
    if "properties" in out:
        out["properties"] = {k: {n: once(v) if n in ("type", "enum") else v for n, v in p.items()} for k, p in out["properties"].items()}
    return out


@functools.cache
def shared_registry() -> Registry:
    """The one registry of this process, made when first asked for."""
    return default_registry()


def default_registry() -> Registry:
    """The base classes and the classes used by the bundled projections."""
    base = ClassSchema("GraphObject", (), {"_key": _TEXT, "_type": _TEXT, "_class": _LIST}, ("_key", "_type", "_class"))
    entity = ClassSchema("Entity", ("GraphObject",), {"id": _LIST, "name": _TEXT, "displayName": _TEXT, "summary": _TEXT, "description": _TEXT, "classification": _TEXT, "criticality": Property("integer"), "tags": _LIST, "owner": _TEXT, "email": Property(format="email"), "active": _FLAG, "public": _FLAG, "createdOn": Property("integer"), "updatedOn": Property("integer"), "status": _TEXT, "webLink": Property(format="uri")}, ("name", "displayName"))
    record = ClassSchema("RecordEntity", ("GraphObject",), {"name": _TEXT, "displayName": _TEXT, "category": _TEXT, "content": _TEXT, "open": _FLAG, "createdOn": Property("integer")}, ("name", "displayName"))
    own = lambda cls, parent="Entity", required=(), /, **p: ClassSchema(cls, (parent,), p, required)
    return Registry([
        base, entity, record,
        own("Finding", "RecordEntity", ("category", "severity", "numericSeverity", "open"), severity=_TEXT, numericSeverity=_NUMBER),
        own("Account", accountId=_TEXT, accessURL=Property(format="uri"), vendor=_TEXT), own("ApplicationEndpoint", ipAddress=Property(format="ip"), url=Property(format="uri")),
        own("Channel", private=_FLAG), own("Document", "Entity", ("location",), location=_TEXT, version=_TEXT), own("DataStore", "Entity", ("classification", "encrypted"), encrypted=_FLAG), own("Key", fingerprint=_TEXT, material=_TEXT),
        own("Group", email=Property(format="email")), own("Host", ipAddress=Property(format="ip"), hostname=_TEXT, platform=Property(enum=("darwin", "linux", "windows", "other"))), own("Network", CIDR=Property(format="ipCidr"), environment=_TEXT, public=_FLAG, internal=_FLAG),
        own("Person", "Entity", ("firstName", "lastName"), firstName=_TEXT, lastName=_TEXT), own("Product", sku=_TEXT, price=_NUMBER), own("Record", "GraphObject", ("name",), name=_TEXT, displayName=_TEXT, amount=_NUMBER, status=_TEXT),
        own("Site", category=_TEXT, location=_TEXT), own("User", "Entity", ("username",), username=_TEXT, mfaEnabled=_FLAG), own("Vendor", category=_TEXT), own("Secret"),
    ])
