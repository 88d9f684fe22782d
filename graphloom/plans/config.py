"""Configuration of a run: fields from the environment, options of a synchronisation, pipeline modules."""

from __future__ import annotations

import importlib.util
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from ..model.errors import ConfigError, ConfigFieldMissingError, ConfigFieldTypeError

API, MANAGED, EXTERNAL, INTERNAL = "api", "integration-managed", "integration-external", "system-internal"
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def snake_case_of(name: str) -> str:
    """``apiKey``, ``API key`` and ``api-key`` as ``api_key``; other characters than letters and digits part words."""
    return "_".join(w.lower() for w in _WORD.findall(name))


@dataclass(frozen=True)
class Field:
    """A field: string, boolean or json; masked ones are secrets."""

    type: str = "string"
    optional: bool = False
    mask: bool = False


def convert(name: str, field: Field, value: str):
    """The text of an environment variable as the field's type."""
    if field.type == "json":
        try:
            return json.loads(value)
        except ValueError as e:
            raise ConfigFieldTypeError(f"field {name} is not valid JSON: {e}") from e
    if field.type == "boolean":
        flags = {"true": True, "false": False}
        if value.lower() not in flags:
            raise ConfigFieldTypeError(f"field {name} is neither true nor false: {value}")
        return flags[value.lower()]
    return value


def from_environment(fields: Mapping[str, Field], environment: Mapping[str, str] | None = None) -> dict:
    """Values of all fields set, by variables in upper snake case; a missing one that is not optional raises."""
    env = os.environ if environment is None else environment
    out = {}
    for name, field in fields.items():
        variable = snake_case_of(name).upper()
        if variable in env:
            out[name] = convert(name, field, env[variable])
        elif not field.optional:
            raise ConfigFieldMissingError(f"field {name}: variable {variable} is not set")
    return out


def masked_fields(fields: Mapping[str, Field]) -> list[str]:
    return [name for name, field in fields.items() if field.mask]


def check_sync(source: str, scope: str | None = None, instance: str | None = None) -> None:
    """An api synchronisation has a scope and no instance; the others have an instance."""
    if source not in (API, MANAGED, EXTERNAL):
        raise ConfigError(f"unknown source {source}")
    if source == API and (instance or not scope):
        raise ConfigError("an api synchronisation takes a scope and no instance")
    if source != API and not instance:
        raise ConfigError(f"a synchronisation of source {source} takes an instance")


def job_fields(source: str, scope: str | None = None, instance: str | None = None, job: str | None = None) -> dict[str, str | None]:
    """What a new job states, by source."""
    of_scope = {"scope": scope} if source in (API, INTERNAL) else {}
    of_instance = {} if source == API else {"integrationInstanceId": instance, "integrationJobId": job}
    return {"source": source, **of_scope, **of_instance}


def entity_type(vendor: str, name: str) -> str:
    """``vendor_name`` in snake case, of the letters, digits and ``_`` that a type may have; a part without any raises."""
    parts = [snake_case_of(vendor), snake_case_of(name)]
    if not all(parts):
        raise ConfigError(f"not a type name: {vendor!r}, {name!r}")
    return "_".join(parts)


@dataclass(frozen=True)
class Instance:
    """Who a run is for: an instance with its configuration and the ingestion sources that are switched off."""

    id: str
    config: dict
    disabled_sources: tuple[str, ...] = ()


def local_instance(fields: Mapping[str, Field], environment: Mapping[str, str] | None = None) -> Instance:
    """An instance for a run on this machine, from the environment; ``DISABLED_INGESTION_SOURCES`` has the sources off, with commas between them."""
    env = os.environ if environment is None else environment
    off = tuple(x.strip() for x in env.get("DISABLED_INGESTION_SOURCES", "").split(",") if x.strip())
    return Instance(env.get("INSTANCE_ID", "local-instance"), from_environment(fields, env), off)


def load_pipeline(path: str):
    """The object ``pipeline`` of a Python file."""
    spec = importlib.util.spec_from_file_location("graphloom_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, "pipeline"):
        raise ConfigError(f"{path} defines no pipeline")
    return module.pipeline
