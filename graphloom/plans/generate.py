"""A new project from answers: what an interactive generator would ask, as data, and the files that it makes."""

from __future__ import annotations

import json

from ..model.errors import ConfigError
from ..model.registry import Registry, default_registry
from .config import Field, entity_type


def entity_answers(vendor: str, answers: list[dict], registry: Registry | None = None) -> list[dict]:
    """Entities (name, type, classes) of answers (name, class or classes); an unknown class raises."""
    known = registry or default_registry()
    out = []
    for a in answers:
        classes = a.get("classes") or [a["class"]]
        if bad := [c for c in classes if c not in known.schemas]:
            raise ConfigError(f"unknown classes {bad}")
        out.append({"name": a["name"], "type": a.get("type") or entity_type(vendor, a["name"]), "classes": classes})
    return out


def relationship_choices(entities: list[dict], registry: Registry | None = None) -> dict[str, list[str]]:
    """What a relationship can be made of: entities by name, and relationship classes sorted."""
    names = sorted(e["name"] for e in entities)
    return {"from": names, "to": names, "class": sorted((registry or default_registry()).relationship_classes)}


def relationship_answers(entities: list[dict], answers: list[dict], registry: Registry | None = None) -> list[dict]:
    """Relationships (source type, class, target type) of answers (from, class, to), each among the choices."""
    choices, types = relationship_choices(entities, registry), {e["name"]: e["type"] for e in entities}
    for a in answers:
        if bad := [k for k in ("from", "to", "class") if a[k] not in choices[k]]:
            raise ConfigError(f"not a choice: { {k: a[k] for k in bad} }")
    return [{"source": types[a["from"]], "class": a["class"], "target": types[a["to"]]} for a in answers]


def step_answers(answers: list[dict]) -> list[dict]:
    """Steps (id, name, dependsOn) of answers; ids are distinct and a step depends on others alone."""
    ids = [a["id"] for a in answers]
    for a in answers:
        on = a.get("dependsOn", [])
        if ids.count(a["id"]) > 1 or a["id"] in on or set(on) - set(ids):
            raise ConfigError(f"step {a['id']} repeats, or depends on itself or on an unknown step")
    return [{"id": a["id"], "name": a.get("name", a["id"]), "dependsOn": a.get("dependsOn", [])} for a in answers]


def config_answers(answers: list[dict]) -> dict[str, Field]:
    """Configuration fields by name, of answers (name, type, mask, optional)."""
    return {a["name"]: Field(a.get("type", "string"), bool(a.get("optional")), bool(a.get("mask"))) for a in answers}


def new_project(answers: dict) -> dict[str, str]:
    """Files by name: the pipeline module that :func:`~.config.load_pipeline` reads, its template of declared steps, and an environment file."""
    entities = entity_answers(answers["vendor"], answers["entities"])
    relationships = relationship_answers(entities, answers.get("relationships", []))
    steps, fields = step_answers(answers["steps"]), config_answers(answers.get("config", []))
    template = {"entities": entities, "relationships": relationships, "steps": steps}
    module = (
        '"""A pipeline of declared steps; each handler returns frames by collection."""\n\n'
        "import json\nimport pathlib\n\nfrom graphloom.plans import dag\n\n"
        'TEMPLATE = json.loads((pathlib.Path(__file__).parent / "template.json").read_text())\n'
        "HANDLERS = {}  # step id to a function of (spark, context, frames made so far)\n\n"
        'pipeline = dag.Pipeline([dag.StepSpec(s["id"], s["name"], depends_on=tuple(s["dependsOn"]), run=HANDLERS.get(s["id"])) for s in TEMPLATE["steps"]])\n'
    )
    from .config import snake_case_of

    return {"pipeline.py": module, "template.json": json.dumps(template, indent=2), ".env": "".join(f"{snake_case_of(n).upper()}=\n" for n in fields)}
