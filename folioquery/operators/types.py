"""Declared types: matching, inheritance, defaults, coercion and computed fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.plans.compiler import Scope, Val, compiler
from folioquery.plans.syntax import children, in_order, parse
from folioquery.plans.syntax import Name as NameNode
from folioquery.values import BOOL, FLOAT, INT, NULL, STRING


@dataclass(frozen=True)
class Field:
    """A declared field. ``values`` are an enum's members in order."""

    type: str = "any"
    required: bool = False
    default: object = ...
    computed: str | None = None
    values: tuple = ()
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    unique_items: bool = False
    deprecated: bool = False


@dataclass(frozen=True)
class TypeDef:
    """A type: its fields, how records match it, and what it extends."""

    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    match: dict = field(default_factory=dict)
    extends: str | None = None
    strict: str | None = None


def inherited(types: dict[str, TypeDef]) -> dict[str, TypeDef]:
    """Types with their parents' fields; a child's field replaces its parent's. Cycles are refused."""
    order = in_order({n: {t.extends} if t.extends else set() for n, t in types.items()})
    out: dict[str, TypeDef] = {}
    for n in order:
        t = types[n]
        parent = out.get(t.extends) if t.extends else None
        out[n] = t if parent is None else replace(t, fields={**parent.fields, **t.fields}, strict=t.strict or parent.strict)
    return out


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``*`` and ``?`` stay in a folder, ``**`` as a whole part spans folders, ``[!..]`` negates."""
    out, parts = "", pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        for token in re.findall(r"\[!?[^\]]+\]|.", part):
            if token == "*":
                out += "[^/]*"
            elif token == "?":
                out += "[^/]"
            elif len(token) > 1:
                out += "[" + ("^/" + token[2:-1] if token[1] == "!" else token[1:-1]).replace("\\", "\\\\") + "]"
            else:
                out += re.escape(token)
        out += "" if last else "/"
    return rf"\A{out}\z"


def match_operator(v: Val, op: str, want: object) -> Column:
    """One operator of a match rule; numbers in texts compare as numbers."""
    text = v.col if v.kind == STRING else F.try_variant_get(v.col, "$", "string") if v.kind.name == "dynamic" else v.col.cast("string")
    number = text.try_cast("double") if v.kind.name != "list" else F.lit(None).cast("double")
    numeric = isinstance(want, (int, float)) and not isinstance(want, bool)
    if op == "exists":
        return v.col.isNotNull() if want else v.col.isNull()
    if op in ("eq", "neq"):
        if isinstance(want, bool):
            same = v.col.eqNullSafe(F.lit(want)) if v.kind == BOOL else F.lit(False)
        elif numeric:
            same = F.coalesce(F.abs(number - want) < 1e-9, F.lit(False))
        else:
            same = text.eqNullSafe(F.lit(want))
        return same if op == "eq" else ~same
    if op in ("gt", "gte", "lt", "lte"):
        a, b = (number, F.lit(float(want))) if numeric else (text, F.lit(str(want)))
        return F.coalesce({"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op], F.lit(False))
    if op in ("contains", "containsAll", "containsAny"):
        wants = want if isinstance(want, list) else [want]
        if v.kind.name == "list":
            each = [F.coalesce(F.array_contains(v.col, w), F.lit(False)) for w in wants]
        else:
            each = [F.contains(text, F.lit(str(w))) for w in wants]
        out = each[0]
        for e in each[1:]:
            out = (out | e) if op == "containsAny" else (out & e)
        return F.coalesce(out, F.lit(False))
    if op in ("startsWith", "endsWith", "matches"):
        f = {"startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[op]
        return F.coalesce(f(text, F.lit(str(want))), F.lit(False))
    return F.lit(True)  # unknown operators are ignored


def matches(records: Records, t: TypeDef) -> Column:
    """Whether a record meets all rules of a type. A type without rules matches nothing by itself."""
    rules = t.match
    tests: list[Column] = []
    for g in [*([rules["path_glob"]] if "path_glob" in rules else []), *([] if "path_globs" not in rules else [rules["path_globs"]])]:
        globs = g if isinstance(g, list) else [g]
        hit = F.lit(False)
        for one in globs:
            hit = hit | F.rlike(records.path, F.lit(glob_regex(one)))
        tests.append(hit)
    for name in rules.get("fields_present", []):
        tests.append(records.fields[name].col.isNotNull() if name in records.fields else F.lit(False))
    for name, ops in rules.get("where", {}).items():
        v = records.fields.get(name, Val(F.lit(None).cast("string"), STRING))
        for op, want in ops.items() if isinstance(ops, dict) else [("eq", ops)]:
            tests.append(match_operator(v, op, want))
    if "match_expr" in rules:
        c = compiler("cel", Scope(dict(records.fields), records.bindings()))
        tests.append(F.coalesce(c.truth(c.text(rules["match_expr"])), F.lit(False)))
    if not tests:
        return F.lit(False)
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def classify(records: Records, types: dict[str, TypeDef]) -> Records:
    """Records with the types they match, in name order. N boolean expressions and no shuffle."""
    found = F.array(*[F.when(matches(records, types[n]), F.lit(n)) for n in sorted(types)])
    return replace(records, types=F.filter(found, lambda t: t.isNotNull()), fixed_types=None)


def with_defaults(records: Records, fields: dict[str, Field], present: dict[str, Column] | None = None) -> Records:
    """Defaults for fields whose key is absent; a null that is written stays null.

    ``present`` says for dynamic sources whether a key is there; a column of a table always is.
    """
    more: dict[str, Val] = {}
    for name, f in fields.items():
        if f.default is ...:
            continue
        kind = {str: STRING, bool: BOOL, int: INT, float: FLOAT}.get(type(f.default), NULL)
        default = F.lit(f.default)
        if name not in records.fields:
            more[name] = Val(default, kind)
        elif present and name in present:
            v = records.fields[name]
            more[name] = Val(F.when(present[name], v.col).otherwise(default.cast("string") if v.kind == STRING else default), v.kind)
    return records.with_fields(**more)


def coerce(v: Val, kind: str) -> Val:
    """A value as a declared type where the text allows it; null where it doesn't."""
    text = F.try_variant_get(v.col, "$", "string") if v.kind.name == "dynamic" else v.col.cast("string")
    if kind in ("string", "enum"):
        return Val(text, STRING)
    if kind == "integer":
        number = text.try_cast("double")
        return Val(F.when(number == F.floor(number), number.try_cast("long")), INT)
    if kind == "number":
        return Val(text.try_cast("double"), FLOAT)
    if kind == "boolean":
        low = F.lower(text)
        return Val(F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False), BOOL)
    return v


def with_coercion(records: Records, fields: dict[str, Field]) -> Records:
    want = {"string": STRING, "enum": STRING, "integer": INT, "number": FLOAT, "boolean": BOOL}
    more = {n: coerce(records.fields[n], f.type) for n, f in fields.items() if n in records.fields and f.type in want and records.fields[n].kind != want[f.type]}
    return records.with_fields(**more)


def with_computed(records: Records, fields: dict[str, Field]) -> Records:
    """Computed fields in the order of what they read; a failing one is null."""
    trees = {n: parse(f.computed) for n, f in fields.items() if f.computed}

    def names(node) -> set[str]:
        own = {node.id} if isinstance(node, NameNode) else set()
        return own.union(*(names(c) for c in children(node)))

    for n in in_order({n: names(t) & set(trees) for n, t in trees.items()}):
        v = compiler("cel", Scope(dict(records.fields), records.bindings())).compile(trees[n])
        records = records.with_fields(**{n: Val(v.col, v.kind)})
    return records


def conflicts(types: dict[str, TypeDef]) -> list[tuple[str, str, str]]:
    """Fields that two types declare with different types."""
    out = []
    names = sorted(types)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out += [(a, b, f) for f in sorted(types[a].fields) if f in types[b].fields and types[a].fields[f].type != types[b].fields[f].type]
    return out


def contract(records: Records, mapping: dict[str, str]) -> dict[str, Val]:
    """A contract's view of records: contract field to the (dotted) field it is read from."""
    from folioquery.plans.query import lookup

    return {k: lookup(source, records, {}, {}) for k, source in mapping.items()}

