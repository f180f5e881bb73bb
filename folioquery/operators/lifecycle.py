"""Values set when records are made or changed, and schemas as declared fields."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.operators.quality import slugify
from folioquery.operators.types import Field
from folioquery.plans.compiler import Scope, Val, compiler, literal
from folioquery.plans.syntax import ExpressionError
from folioquery.values import DATE, NULL, STRING, TIMESTAMP


@dataclass(frozen=True)
class Action:
    """What to set, and when. A value is ``now``, ``today``, ``uuid``, {"slugify": field}, {"copy": field} or {"literal": x}."""

    set: dict[str, object] = field(default_factory=dict)
    when: str | None = None


def run_actions(records: Records, actions: list[Action], *, now: str, timezone: str = "UTC") -> Records:
    """Apply actions in order. All values of an action are read from the records as they were before it."""
    for a in actions:
        scope = Scope(dict(records.fields), records.bindings(), timezone, now)
        c = compiler("cel", scope)
        guard = F.lit(True) if a.when is None else F.coalesce(c.truth(c.text(a.when)), F.lit(False))
        more = {}
        for name, what in a.set.items():
            v = _value(what, records, c)
            old = records.fields.get(name, literal(None))
            old, v = c.like(old, v) if NULL not in (old.kind, v.kind) else (old, v)
            more[name] = Val(F.when(guard, v.col).otherwise(old.col), old.kind if v.kind == NULL else v.kind)
        records = records.with_fields(**more)
    return records


def _value(what: object, records: Records, c) -> Val:
    if what == "now":
        return Val(c.text("now()").col, TIMESTAMP)
    if what == "today":
        return Val(c.text("today()").col, DATE)
    if what == "uuid":
        return Val(F.uuid(), STRING)
    if isinstance(what, dict) and len(what) == 1:
        kind, arg = next(iter(what.items()))
        if kind == "literal":
            return literal(arg)
        if kind in ("copy", "slugify") and arg in records.fields:
            v = records.fields[arg]
            return v if kind == "copy" else Val(slugify(v.col.cast("string")), STRING)
    raise ExpressionError(f"unknown provider {what!r}", "invalid_lifecycle")


def fields_of_schema(schema: dict) -> dict[str, Field]:
    """Declared fields of a JSON Schema object: the keywords that checks cover."""
    out = {}
    formats = {"date": "date", "date-time": "datetime", "time": "time"}
    names = {"string": "string", "integer": "integer", "number": "number", "boolean": "boolean", "array": "list", "object": "object"}
    for name, s in schema.get("properties", {}).items():
        kind = "enum" if "enum" in s else formats.get(s.get("format"), names.get(s.get("type"), "any"))
        out[name] = Field(
            type=kind,
            required=name in schema.get("required", []),
            default=s.get("default", ...),
            values=tuple(s.get("enum", ())),
            min=s.get("minimum"),
            max=s.get("maximum"),
            min_length=s.get("minLength", s.get("minItems")),
            max_length=s.get("maxLength", s.get("maxItems")),
            pattern=s.get("pattern"),
            unique_items=bool(s.get("uniqueItems")),
            deprecated=bool(s.get("deprecated")),
        )
    return out


def digest(document: object) -> str:
    """sha256 of a document's canonical JSON: sorted keys, no spaces."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
