"""Rules, rule sets, statuses and the JSON they are kept in."""

from __future__ import annotations

import dataclasses
import json
from enum import IntEnum
from typing import Any, ClassVar

QUANTIFIERS = ("ONE_ONLY", "ONE_OR_MORE", "ZERO_OR_MORE", "ZERO_ONLY", "ALL")


class SnapshotStatus(IntEnum):
    """The numbers that are stored."""

    INITIALIZED = 0
    HARVESTING = 1
    RETRYING = 2
    HARVESTING_FINISHED_ERROR = 3
    HARVESTING_FINISHED_VALID = 4
    HARVESTING_STOPPED = 5
    INDEXING = 6
    INDEXING_FINISHED_ERROR = 7
    INDEXING_FINISHED_VALID = 8
    VALID = 9
    UNKNOWN = 10
    EMPTY_INCREMENTAL = 11


class BadRule(ValueError):
    """A rule cannot be read from its JSON."""


class Registered:
    """Base of rule classes: ``type`` names them in JSON."""

    registry: ClassVar[dict[str, type]]
    type: ClassVar[str]

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if "type" in cls.__dict__:
            cls.registry[cls.type] = cls


def rule_from_json(base: type[Registered], source: str | dict) -> Any:
    """One rule from JSON with a ``type`` entry; nested rules are read the same way."""
    data = json.loads(source) if isinstance(source, str) else dict(source)
    cls = base.registry.get(data.pop("type", None))
    if cls is None:
        raise BadRule(f"unknown rule type in {source!r}")
    known = {f.name: f for f in dataclasses.fields(cls)}
    if extra := set(data) - set(known):
        raise BadRule(f"unknown settings {sorted(extra)} of {cls.type}")
    for name, f in known.items():
        if "rules" in f.metadata and data.get(name) is not None:
            data[name] = rule_from_json(f.metadata["rules"](), data[name])
    try:
        return cls(**data)
    except TypeError as error:
        raise BadRule(str(error)) from error


def rules_from_json(base: type[Registered], source: str | list, order: str | None = None) -> list:
    """A list of rules, stably sorted by ``order`` if given."""
    rules = [rule_from_json(base, r) for r in (json.loads(source) if isinstance(source, str) else source)]
    return sorted(rules, key=lambda r: getattr(r, order)) if order else rules


def rule_to_json(rule: Any) -> str:
    def plain(r: Any) -> dict:
        return {"type": r.type} | {f.name: plain(v) if isinstance(v := getattr(r, f.name), Registered) else v for f in dataclasses.fields(r)}

    return json.dumps(plain(rule), sort_keys=True)


def schema_of(cls: type) -> dict:
    """A JSON schema of a rule's settings, in the order of definition."""
    names = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}

    def kind(annotation: str) -> dict:
        head = annotation.split("|")[0].strip()
        if head.startswith("list"):
            return {"type": "array"}
        return {"type": names.get(head, "object")}

    properties = {}
    for order, f in enumerate(dataclasses.fields(cls)):
        entry = kind(str(f.type)) | {"title": f.name.replace("_", " "), "order": order}
        if f.default is not dataclasses.MISSING:
            entry["default"] = f.default
        properties[f.name] = entry
    required = [f.name for f in dataclasses.fields(cls) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    return {"title": cls.type, "description": (cls.__doc__ or "").strip(), "type": "object", "properties": properties, "required": required}


def schemas(base: type[Registered]) -> dict[str, dict]:
    return {name: schema_of(cls) for name, cls in sorted(base.registry.items())}
