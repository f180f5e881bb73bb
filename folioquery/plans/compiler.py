"""Syntax trees to Columns: one compiler, and what differs by dialect.

Every node becomes a value and an error Column (null where all is well), so a
row's failure is data and never fails the job. Nothing here runs per row in
Python: the result is an expression that Catalyst optimises with the rest of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.plans.syntax import (
    CEL,
    PLAIN,
    VIEW,
    Binary,
    Call,
    ExpressionError,
    Index,
    ListLit,
    Lit,
    MapLit,
    Member,
    Name,
    Regex,
    Ternary,
    Unary,
    parse,
)
from folioquery.values import BOOL, DATE, DURATION, DYNAMIC, FLOAT, INT, NULL, STRING, TIMESTAMP, Kind, dynamic_kind, list_of

OVERLOAD = "no such overload"


@dataclass(frozen=True)
class Val:
    """A compiled value. ``const`` holds a literal's Python value."""

    col: Column
    kind: Kind
    err: Column | None = None
    const: object = ...


def clock() -> str:
    """The present moment, taken once for a whole operation."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@dataclass
class Scope:
    """What names mean: fields, fixed bindings (as Val or a nested dict) and query-wide constants."""

    fields: dict[str, Val] = field(default_factory=dict)
    bindings: dict[str, object] = field(default_factory=dict)
    timezone: str = "UTC"
    now: str = field(default_factory=lambda: clock())

    def bind(self, **more) -> Scope:
        return Scope(self.fields, {**self.bindings, **more}, self.timezone, self.now)


def errors(*vals: Val) -> Column | None:
    """The first error among operands."""
    cols = [v.err for v in vals if v.err is not None]
    return None if not cols else cols[0] if len(cols) == 1 else F.coalesce(*cols)


def either(a: Column | None, b: Column | None) -> Column | None:
    return a if b is None else b if a is None else F.coalesce(a, b)


def literal(value: object) -> Val:
    if value is None:
        return Val(F.lit(None), NULL, const=None)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, const=value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("long"), INT, const=value)
    if isinstance(value, float):
        return Val(F.lit(value), FLOAT, const=value)
    return Val(F.lit(value), STRING, const=value)


#: What a function gets: the compiler, its target (or none) and its compiled arguments.
Function = Callable[["Compiler", "Val | None", list[Val]], Val]


class Compiler:
    """Compiles trees of one dialect. Subclasses say what the operators mean."""

    grammar = CEL
    functions: dict[str, Function] = {}
    macros: dict[str, Callable] = {}

    def __init__(self, scope: Scope):
        self.scope = scope

    def text(self, source: str) -> Val:
        return self.compile(parse(source, self.grammar))

    def within(self, scope: Scope) -> Compiler:
        return type(self)(scope)

    def compile(self, node) -> Val:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    # -- leaves -------------------------------------------------------------
    def on_lit(self, node: Lit) -> Val:
        return literal(node.value)

    def on_name(self, node: Name) -> Val:
        bound = self.scope.bindings.get(node.id)
        if isinstance(bound, Val):
            return bound
        if bound is None and node.id in self.scope.fields:
            return self.scope.fields[node.id]
        if isinstance(bound, dict):
            raise ExpressionError(f"{node.id} can only be used with a member")
        return self.unbound(node.id)

    def unbound(self, name: str) -> Val:
        return literal(None)

    def on_member(self, node: Member) -> Val:
        if isinstance(node.target, Name) and isinstance(self.scope.bindings.get(node.target.id), dict):
            found = self.scope.bindings[node.target.id].get(node.name)
            return found if found is not None else self.unbound(f"{node.target.id}.{node.name}")
        return self.member(self.compile(node.target), node.name, node.optional)

    def member(self, v: Val, name: str, optional: bool) -> Val:
        if v.kind.name == "map" and v.kind.fields:
            inner = v.kind.member(name)
            return self.missing(v, name, optional) if inner is None else Val(v.col[name], inner, v.err)
        if v.kind.name == "map":
            return Val(F.try_element_at(v.col, F.lit(name)), v.kind.item or DYNAMIC, v.err)
        if v.kind.name == "dynamic":
            return Val(F.try_variant_get(v.col, f"$.{name}", "variant"), DYNAMIC, v.err)
        return self.missing(v, name, optional)

    def missing(self, v: Val, name: str, optional: bool) -> Val:
        return Val(F.lit(None), NULL, v.err)

    def on_index(self, node: Index) -> Val:
        v, i = self.compile(node.target), self.compile(node.index)
        if v.kind.name == "map" or (v.kind.name == "dynamic" and isinstance(i.const, str)):
            if not isinstance(i.const, str):
                raise ExpressionError("a map is indexed with a fixed name")
            return self.member(v, i.const, False)
        if v.kind.name == "string":
            return Val(F.nullif(F.substring(v.col, (i.col + 1).cast("int"), F.lit(1)), F.lit("")), STRING, errors(v, i))
        if v.kind.name == "dynamic":
            return Val(F.try_variant_get(v.col, f"$[{i.const}]", "variant"), DYNAMIC, errors(v, i))
        return self.element(v, i)

    def element(self, v: Val, i: Val) -> Val:
        at = i.col.cast("int")
        at = F.when(at < 0, F.size(v.col) + at).otherwise(at)
        return Val(F.get(v.col, at), v.kind.item or DYNAMIC, errors(v, i))

    def on_listlit(self, node: ListLit) -> Val:
        items = [self.compile(x) for x in node.items]
        kinds = {v.kind for v in items if v.kind != NULL}
        if kinds == {INT, FLOAT}:
            items, kinds = [Val(v.col.cast("double"), FLOAT, v.err, v.const) for v in items], {FLOAT}
        if len(kinds) > 1:
            items, kinds = [self.dynamic(v) for v in items], {DYNAMIC}
        const = [v.const for v in items] if all(v.const is not ... for v in items) else ...
        return Val(F.array(*[v.col for v in items]), list_of(kinds.pop() if kinds else NULL), errors(*items), const)

    def on_maplit(self, node: MapLit) -> Val:
        pairs = [(self.compile(k).const, self.compile(v)) for k, v in node.items]
        if not all(isinstance(k, str) for k, _ in pairs):
            raise ExpressionError("keys of a map must be fixed text")
        col = F.struct(*[v.col.alias(k) for k, v in pairs])
        return Val(col, Kind("map", fields=tuple((k, v.kind) for k, v in pairs)), errors(*[v for _, v in pairs]))

    def on_regex(self, node: Regex) -> Val:
        flags = "".join(f for f in node.flags if f in "ims")
        return Val(F.lit(f"(?{flags}){node.pattern}" if flags else node.pattern), Kind("regex"), const=node)

    def dynamic(self, v: Val) -> Val:
        if v.kind == DYNAMIC:
            return v
        text = F.to_json(F.struct(v.col.alias("v")))
        return Val(F.try_variant_get(F.try_parse_json(text), "$.v", "variant"), DYNAMIC, v.err)

    def concrete(self, v: Val, kind: Kind) -> Val:
        """A dynamic value as ``kind``; null where it is of another JSON kind."""
        if v.kind != DYNAMIC or kind == DYNAMIC or kind == NULL:
            return v
        want, sql = {"int": ("number", "double"), "float": ("number", "double"), "bool": ("bool", "boolean"), "string": ("string", "string")}.get(kind.name, (None, None))
        if want is None:
            return v
        got = F.when(dynamic_kind(v.col) == want, F.try_variant_get(v.col, "$", sql))
        return Val(got, FLOAT if want == "number" else kind, v.err)

    def meet(self, a: Val, b: Val) -> tuple[Val, Val]:
        """Operands with dynamic ones read as the other's kind, and numbers of one type."""
        if a.kind == DYNAMIC and b.kind == DYNAMIC:
            return tuple(Val(F.to_json(v.col), STRING, v.err) for v in (a, b))
        return self.concrete(a, b.kind), self.concrete(b, a.kind)

    # -- operators ----------------------------------------------------------
    def on_ternary(self, node: Ternary) -> Val:
        return self.choose(self.compile(node.test), self.compile(node.yes), self.compile(node.no))

    def choose(self, test: Val, yes: Val, no: Val) -> Val:
        cond = self.truth(test)
        yes, no = self.like(yes, no)
        err = F.when(cond, yes.err if yes.err is not None else F.lit(None)).otherwise(no.err if no.err is not None else F.lit(None))
        return Val(F.when(cond, yes.col).otherwise(no.col), no.kind if yes.kind == NULL else yes.kind, either(test.err, err if yes.err is not None or no.err is not None else None))

    def like(self, a: Val, b: Val) -> tuple[Val, Val]:
        if a.kind == b.kind or NULL in (a.kind, b.kind):
            return a, b
        if a.kind.numeric and b.kind.numeric:
            return Val(a.col.cast("double"), FLOAT, a.err), Val(b.col.cast("double"), FLOAT, b.err)
        return self.dynamic(a), self.dynamic(b)

    def on_unary(self, node: Unary) -> Val:
        v = self.compile(node.operand)
        if node.op == "!":
            return Val(~self.truth(v), BOOL, v.err)
        if node.op == "+":
            return self.number(v)
        v = self.number(v)
        return Val(-v.col, v.kind, v.err)

    def on_binary(self, node: Binary) -> Val:
        left, right = self.compile(node.left), self.compile(node.right)
        if node.op in ("&&", "||"):
            return self.logic(node.op, left, right)
        if node.op in ("==", "!="):
            v = self.equal(left, right)
            return v if node.op == "==" else Val(~v.col, BOOL, v.err)
        if node.op in ("<", "<=", ">", ">="):
            return self.compare(node.op, left, right)
        if node.op == "in":
            return self.contains(right, left)
        if node.op == "??":
            left, right = self.like(left, right)
            return Val(F.coalesce(left.col, right.col), right.kind if left.kind == NULL else left.kind, left.err)
        if node.op == "+":
            return self.add(left, right)
        return self.arithmetic(node.op, left, right)

    def on_call(self, node: Call) -> Val:
        if node.name in self.macros and (node.target is not None or node.name in ("has", "reduce")):
            out = self.macros[node.name](self, node)
            if out is not None:
                return out
        if isinstance(node.target, Name) and isinstance(self.scope.bindings.get(node.target.id), dict):
            target = Val(F.lit(None), Kind("file"), const=self.scope.bindings[node.target.id])
        else:
            target = self.compile(node.target) if node.target is not None else None
        fn = self.functions.get(node.name)
        if fn is None:
            raise ExpressionError(f"unknown function {node.name}", "unknown_function")
        try:
            return fn(self, target, [self.compile(a) for a in node.args])
        except IndexError:
            raise ExpressionError(f"{node.name}: wrong number of arguments", "wrong_argument_count") from None

    def contains(self, items: Val, v: Val) -> Val:
        err = errors(items, v)
        if isinstance(items.const, list) and items.const and v.kind.name in ("string", "int", "float", "bool"):
            # a fixed list stays an IN, which reaches the scan
            return Val(v.col.isNotNull() & v.col.isin([x for x in items.const if x is not None]), BOOL, err)
        if items.kind.name == "map":
            return Val(F.lit(v.const in dict(items.kind.fields)) if items.kind.fields else F.map_contains_key(items.col, v.col), BOOL, err)
        if items.kind.name == "string":
            return Val(F.contains(items.col, v.col), BOOL, err)
        if items.kind.name != "list":
            return Val(F.lit(None).cast("boolean"), BOOL, either(err, F.lit(OVERLOAD)))
        return Val(F.exists(items.col, lambda x: self.equal(Val(x, items.kind.item), v).col), BOOL, err)

    def equal(self, a: Val, b: Val) -> Val:
        err = errors(a, b)
        if b.kind == NULL:
            return Val(a.col.isNull(), BOOL, err)
        if a.kind == NULL:
            return Val(b.col.isNull(), BOOL, err)
        a, b = self.meet(a, b)
        if a.kind.name == b.kind.name or (a.kind.numeric and b.kind.numeric) or {a.kind.name, b.kind.name} == {"date", "timestamp"}:
            return Val(a.col.eqNullSafe(b.col), BOOL, err)
        if {a.kind.name, b.kind.name} <= {"string", "date", "timestamp"}:
            return Val(a.col.cast("string").eqNullSafe(b.col.cast("string")), BOOL, err)
        return Val(a.col.isNull() & b.col.isNull(), BOOL, err)

    def ordered(self, op: str, a: Column, b: Column) -> Column:
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    # -- what dialects define -------------------------------------------------
    def truth(self, v: Val) -> Column:
        raise NotImplementedError

    def logic(self, op: str, a: Val, b: Val) -> Val:
        raise NotImplementedError

    def number(self, v: Val) -> Val:
        raise NotImplementedError

    def compare(self, op: str, a: Val, b: Val) -> Val:
        raise NotImplementedError

    def add(self, a: Val, b: Val) -> Val:
        raise NotImplementedError

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        raise NotImplementedError


def duration(months: Column, millis: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), millis.cast("long").alias("millis"))


def shift(date: Val, amount: Val, sign: int) -> Val:
    """A date or timestamp moved by a duration: months first (clamped to the month's end), then the exact part."""
    months, millis = amount.col["months"] * sign, amount.col["millis"] * sign
    if date.kind == DATE:
        # a date without a time drops what is less than a day
        return Val(F.date_add(F.add_months(date.col, months), (millis / 86_400_000).cast("int")), DATE, errors(date, amount))
    ts = date.col.cast("timestamp_ntz")
    day = ts.cast("date")
    moved = F.add_months(day, months).cast("timestamp_ntz") + (ts - day.cast("timestamp_ntz"))
    return Val(moved + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)")), TIMESTAMP, errors(date, amount))


#: Units of duration texts in milliseconds, and calendar units in months.
UNIT_MS = {
    "ms": 1, "s": 1000, "second": 1000, "seconds": 1000, "m": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
    "w": 604_800_000, "week": 604_800_000, "weeks": 604_800_000,
}
UNIT_MONTHS = {"M": 1, "month": 1, "months": 1, "y": 12, "year": 12, "years": 12}

_TERM = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$"
_DAY, _MOMENT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$"


def dated(text: str) -> bool:
    return re.match(_DAY, text) is not None or re.match(_MOMENT, text) is not None


def is_dated(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_DAY)) | F.rlike(text, F.lit(_MOMENT)), F.lit(False))


def fixed_duration(text: str) -> bool:
    found = re.match(_TERM, text)
    return found is not None and (found[2] in UNIT_MS or found[2] in UNIT_MONTHS)


def duration_parts(text: Column) -> tuple[Column, Column, Column]:
    """Amount, months and milliseconds of the unit of texts such as ``7d`` or ``1 month``; units are null if there are none."""
    table = lambda units: F.create_map(*[F.lit(x) for k, n in units.items() for x in (k, n)])
    unit = F.regexp_extract(text, _TERM, 2)
    return F.regexp_extract(text, _TERM, 1).try_cast("double"), F.try_element_at(table(UNIT_MONTHS), unit), F.try_element_at(table(UNIT_MS), unit)


def text_duration(v: Val) -> Val:
    """One number and unit as a duration; months and years move by the calendar. Null where the text is none."""
    n, months, ms = duration_parts(v.col)
    whole = F.coalesce((n * months).cast("int"), F.lit(0))
    exact = F.coalesce((n * ms).cast("long"), F.lit(0).cast("long"))
    known = n.isNotNull() & (months.isNotNull() | ms.isNotNull())
    return Val(F.when(known, duration(whole, exact)), DURATION, v.err)


def moved_text(text: Column, amount: Val, sign: int) -> Column:
    """A date or moment written as text, moved and written the same way; null if it is none."""
    day = Val(F.when(F.rlike(text, F.lit(_DAY)), text.try_cast("date")), DATE)
    moment = Val(F.when(F.rlike(text, F.lit(_MOMENT)), F.substring(text, 1, 19).try_cast("timestamp_ntz")), TIMESTAMP)
    mark = F.when(F.endswith(text, F.lit("Z")) & (amount.col["months"] == 0), "Z").otherwise("")
    written = F.concat(F.date_format(shift(moment, amount, sign).col, "yyyy-MM-dd'T'HH:mm:ss"), mark)
    return F.coalesce(shift(day, amount, sign).col.cast("string"), written)


def difference(a: Val, b: Val) -> Column:
    """Milliseconds between two dates or timestamps."""
    x, y = (F.unix_micros(v.col.cast("timestamp")) for v in (a, b))
    return ((x - y) / 1000).cast("long")


class CelCompiler(Compiler):
    """Canonical expressions: strict kinds; errors are null values with a reason."""

    grammar = CEL
    functions: dict[str, Function] = {}
    macros: dict[str, Callable] = {}
    RESERVED = ("record", "raw", "file", "projection", "this", "values", "types")

    def unbound(self, name: str) -> Val:
        if name in self.RESERVED:
            raise ExpressionError(f"{name} is not available here", "invalid_query")
        return literal(None)

    def missing(self, v: Val, name: str, optional: bool) -> Val:
        if optional:
            return Val(F.lit(None), NULL, v.err)
        return Val(F.lit(None), NULL, either(v.err, F.lit(f"no such key: {name}")))

    def strict(self, col: Column, kind: Kind, *vals: Val, why: str = OVERLOAD) -> Val:
        """A result that is an error where it is null."""
        return Val(col, kind, either(errors(*vals), F.when(col.isNull(), F.lit(why))))

    def truth(self, v: Val) -> Column:
        v = self.concrete(v, BOOL)
        return v.col if v.kind == BOOL else F.lit(None).cast("boolean")

    def logic(self, op: str, a: Val, b: Val) -> Val:
        x, y = self.truth(a), self.truth(b)
        col = x & y if op == "&&" else x | y
        # a decided side absorbs the other's error
        return Val(col, BOOL, F.when(col.isNull(), F.coalesce(*[e for e in (errors(a, b), F.lit(OVERLOAD)) if e is not None])))

    def number(self, v: Val) -> Val:
        v = self.concrete(v, FLOAT)
        return v if v.kind.numeric else self.strict(F.lit(None).cast("double"), FLOAT, v)

    def compare(self, op: str, a: Val, b: Val) -> Val:
        a, b = self.meet(a, b)
        times = {"date", "timestamp"}
        if a.kind.name == b.kind.name == "duration":
            return self.strict(self.ordered(op, a.col["millis"], b.col["millis"]), BOOL, a, b)
        if (a.kind.numeric and b.kind.numeric) or a.kind == b.kind or {a.kind.name, b.kind.name} <= times:
            return self.strict(self.ordered(op, a.col, b.col), BOOL, a, b)
        if {a.kind.name, b.kind.name} <= times | {"string"}:
            return self.strict(self.ordered(op, a.col.cast("string"), b.col.cast("string")), BOOL, a, b)
        return self.strict(F.lit(None).cast("boolean"), BOOL, a, b)

    def add(self, a: Val, b: Val) -> Val:
        a, b = self.meet(a, b)
        if a.kind == b.kind == STRING:
            return self.strict(F.concat(a.col, b.col), STRING, a, b)
        if a.kind.name == b.kind.name == "list":
            return self.strict(F.concat(a.col, b.col), a.kind if a.kind.item != NULL else b.kind, a, b)
        if a.kind.name in ("date", "timestamp") and b.kind == DURATION:
            return shift(a, b, 1)
        return self.arithmetic("+", a, b)

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if op == "-" and a.kind.name in ("date", "timestamp"):
            if b.kind == DURATION:
                return shift(a, b, -1)
            if b.kind.name in ("date", "timestamp"):
                return Val(duration(F.lit(0), difference(a, b)), DURATION, errors(a, b))
        a, b = self.number(a), self.number(b)
        whole = a.kind == b.kind == INT
        why = "division by zero" if op in "/%" else "overflow" if whole else OVERLOAD
        if op == "+":
            col = F.try_add(a.col, b.col)
        elif op == "-":
            col = F.try_subtract(a.col, b.col)
        elif op == "*":
            col = F.try_multiply(a.col, b.col)
        elif op == "/":
            col = F.call_function("div", a.col, F.nullif(b.col, F.lit(0))) if whole else F.try_divide(a.col, b.col)
        else:
            col = F.try_mod(a.col, b.col)
        return self.strict(col, INT if whole else FLOAT, a, b, why=why)

    def element(self, v: Val, i: Val) -> Val:
        col = F.get(v.col, i.col.cast("int"))
        outside = F.when((i.col < 0) | (i.col >= F.size(v.col)), F.lit("index out of bounds"))
        return Val(col, v.kind.item or DYNAMIC, either(errors(v, i), outside))


class PlainCompiler(Compiler):
    """The older filter language: nulls flow through, truthiness decides, and logic returns operands."""

    grammar = PLAIN
    functions: dict[str, Function] = {}
    macros: dict[str, Callable] = {}

    def truth(self, v: Val) -> Column:
        k = v.kind.name
        if k == "bool":
            return F.coalesce(v.col, F.lit(False))
        if k == "null":
            return F.lit(False)
        if k in ("int", "float"):
            return F.coalesce(v.col != 0, F.lit(False))
        if k == "string":
            return F.coalesce(v.col != "", F.lit(False))
        if k == "list":
            return F.coalesce(F.size(v.col) > 0, F.lit(False))
        if k == "dynamic":
            return ~(v.col.isNull() | F.to_json(v.col).isin("null", "false", "0", "0.0", '""', "[]"))
        return v.col.isNotNull()

    def logic(self, op: str, a: Val, b: Val) -> Val:
        cond = self.truth(a)
        if a.kind == b.kind == BOOL:
            y = self.truth(b)
            return Val(cond & y if op == "&&" else cond | y, BOOL, a.err)
        x, y = self.like(a, b)
        kind = y.kind if x.kind == NULL else x.kind
        return Val(F.when(cond, y.col if op == "&&" else x.col).otherwise(x.col if op == "&&" else y.col), kind, a.err)

    def number(self, v: Val) -> Val:
        v = self.concrete(v, FLOAT)
        if v.kind.numeric:
            return v
        return Val(F.lit(None).cast("double"), FLOAT, either(v.err, F.when(v.col.isNotNull(), F.lit("type_error"))))

    def compare(self, op: str, a: Val, b: Val) -> Val:
        a, b = self.meet(a, b)
        if {a.kind.name, b.kind.name} <= {"int", "float"} or a.kind == b.kind:
            col = self.ordered(op, a.col, b.col)
        elif {a.kind.name, b.kind.name} <= {"string", "date", "timestamp"}:
            col = self.ordered(op, a.col.cast("string"), b.col.cast("string"))
        elif {a.kind.name, b.kind.name} <= {"string", "int", "float"}:
            col = self.ordered(op, a.col.try_cast("double"), b.col.try_cast("double"))
        else:
            col = F.lit(False)
        return Val(F.coalesce(col, F.lit(False)), BOOL, errors(a, b))

    #: Formulas join texts with other values; filters call that a type error.
    joins_text = True

    def add(self, a: Val, b: Val) -> Val:
        """Dates move by duration texts from either side; texts are joined, with ``null`` for what is missing."""
        times = ("date", "timestamp")
        if "list" in (a.kind.name, b.kind.name):
            return self.mismatch(F.lit(None).cast("string"), STRING, a, b, where=F.lit(True))
        if a.kind.name in times and b.kind == DURATION:
            return shift(a, b, 1)
        if a.kind.name in times and b.kind == STRING:
            return self.moved(a, b, 1)
        if a.kind.name in times and b.kind.name in times:
            return self.mismatch(F.lit(None).cast("string"), STRING, a, b, where=a.col.isNotNull() & b.col.isNotNull())
        if b.kind.name in times and a.kind == STRING and isinstance(a.const, str) and fixed_duration(a.const):
            return self.moved(b, a, 1)
        if STRING not in (a.kind, b.kind) and a.kind.name not in times and b.kind.name not in times:
            return self.arithmetic("+", a, b)
        return self.joined(a, b)

    def joined(self, a: Val, b: Val) -> Val:
        x, y = a.col.cast("string"), b.col.cast("string")
        both = {a.kind.name, b.kind.name} <= {"string", "date", "timestamp"}
        # a null is no text: what is left then decides whether this is still a join of texts
        text_there = F.lit(False)
        for v in (a, b):
            if v.kind.name in ("string", "date", "timestamp"):
                text_there = text_there | v.col.isNotNull()
        plain = F.when(text_there, F.concat(F.coalesce(x, F.lit("null")), F.coalesce(y, F.lit("null"))))
        wrong = F.lit(False)
        if not self.joins_text:
            wrong = text_there & (x.isNull() | y.isNull() | F.lit(not both))
        if a.kind == b.kind == STRING:
            if not isinstance(a.const, str) or dated(a.const):
                later = moved_text(x, text_duration(b), 1)
                wrong = wrong | (is_dated(x) & y.isNotNull() & later.isNull())
                plain = F.when(is_dated(x) & y.isNotNull(), later).otherwise(plain)
            if not isinstance(a.const, str) or fixed_duration(a.const):
                later = moved_text(y, text_duration(a), 1)
                plain = F.when(~is_dated(x) & later.isNotNull(), later).otherwise(plain)
        return self.mismatch(F.when(~wrong, plain), STRING, a, b, where=wrong)

    def moved(self, date: Val, text: Val, sign: int) -> Val:
        out = shift(date, text_duration(text), sign)
        return self.mismatch(out.col, out.kind, date, text, where=date.col.isNotNull() & text.col.isNotNull() & out.col.isNull())

    def mismatch(self, col: Column, kind: Kind, *vals: Val, where: Column) -> Val:
        return Val(col, kind, either(errors(*vals), F.when(where, F.lit("type_error"))))

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if op == "-" and a.kind.name in ("date", "timestamp"):
            if b.kind == DURATION:
                return shift(a, b, -1)
            if b.kind.name in ("date", "timestamp"):
                return Val(difference(a, b), INT, errors(a, b))
            if b.kind == STRING and not (isinstance(b.const, str) and dated(b.const)):
                return self.moved(a, b, -1)
            if b.kind == STRING:
                return Val(difference(a, Val(b.col.try_cast("timestamp"), TIMESTAMP)), INT, errors(a, b))
        if op == "-" and a.kind == STRING and isinstance(b.const, str) and fixed_duration(b.const):
            out = moved_text(a.col, text_duration(b), -1)
            return self.mismatch(out, STRING, a, b, where=a.col.isNotNull() & out.isNull())
        a, b = self.number(a), self.number(b)
        whole = a.kind == b.kind == INT
        if op == "+":
            col = F.try_add(a.col, b.col)
        elif op == "-":
            col = F.try_subtract(a.col, b.col)
        elif op == "*":
            col = F.try_multiply(a.col, b.col)
        elif op == "/":
            col, whole = F.try_divide(a.col, b.col), False
        else:
            col = F.try_mod(a.col, b.col)
        return Val(col, INT if whole else FLOAT, errors(a, b))


class ViewCompiler(Compiler):
    """Saved view files: all numbers are doubles, null counts as 0 in arithmetic, logic returns booleans."""

    grammar = VIEW
    functions: dict[str, Function] = {}
    macros: dict[str, Callable] = {}

    def truth(self, v: Val) -> Column:
        k = v.kind.name
        if k == "list":
            return v.col.isNotNull()  # also []
        if k == "bool":
            return F.coalesce(v.col, F.lit(False))
        if k == "null":
            return F.lit(False)
        if k in ("int", "float"):
            return F.coalesce((v.col != 0) & ~F.isnan(v.col.cast("double")), F.lit(False))
        if k == "string":
            return F.coalesce(v.col != "", F.lit(False))
        if k == "dynamic":
            return ~(v.col.isNull() | F.to_json(v.col).isin("null", "false", "0", "0.0", '""'))
        return v.col.isNotNull()

    def logic(self, op: str, a: Val, b: Val) -> Val:
        x, y = self.truth(a), self.truth(b)
        return Val(x & y if op == "&&" else x | y, BOOL, errors(a, b))

    def number(self, v: Val) -> Val:
        k = v.kind.name
        if k in ("int", "float"):
            col = F.coalesce(v.col.cast("double"), F.lit(0.0))
        elif k == "null":
            col = F.lit(0.0)
        elif k == "bool":
            col = F.coalesce(v.col.cast("double"), F.lit(0.0))
        elif k == "string":
            col = F.coalesce(F.trim(v.col).try_cast("double"), F.lit(float("nan")))
        elif k == "dynamic":
            col = F.coalesce(F.try_variant_get(v.col, "$", "double"), F.lit(0.0))
        else:
            return Val(F.lit(None).cast("double"), FLOAT, either(v.err, F.lit("expected a number")))
        return Val(col, FLOAT, v.err)

    def compare(self, op: str, a: Val, b: Val) -> Val:
        a, b = self.meet(a, b)
        if {a.kind.name, b.kind.name} <= {"date", "timestamp"} or a.kind == b.kind == STRING:
            col = self.ordered(op, a.col, b.col)
        elif {a.kind.name, b.kind.name} <= {"string", "date", "timestamp"}:
            col = self.ordered(op, a.col.cast("string"), b.col.cast("string"))
        else:
            x, y = self.number(a), self.number(b)
            col = self.ordered(op, x.col, y.col) & a.col.isNotNull() & b.col.isNotNull()
        return Val(F.coalesce(col, F.lit(False)), BOOL, errors(a, b))

    def add(self, a: Val, b: Val) -> Val:
        if a.kind.name in ("date", "timestamp") and b.kind == DURATION:
            return shift(a, b, 1)
        if STRING in (a.kind, b.kind):
            return Val(F.concat(self.shown(a), self.shown(b)), STRING, errors(a, b))
        return self.arithmetic("+", a, b)

    def shown(self, v: Val) -> Column:
        """How a value reads as text; whole numbers without a fraction."""
        if v.kind.numeric:
            whole = v.col.cast("double") == F.floor(v.col.cast("double"))
            return F.coalesce(F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string")), F.lit(""))
        if v.kind.name in ("list", "map"):
            return F.coalesce(F.to_json(v.col), F.lit(""))
        return F.coalesce(v.col.cast("string"), F.lit(""))

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if op == "-" and a.kind.name in ("date", "timestamp"):
            if b.kind == DURATION:
                return shift(a, b, -1)
            if b.kind.name in ("date", "timestamp"):
                return Val(duration(F.lit(0), difference(a, b)), DURATION, errors(a, b))
        if a.kind == b.kind == DURATION and op in "+-":
            s = 1 if op == "+" else -1
            return Val(duration(a.col["months"] + b.col["months"] * s, a.col["millis"] + b.col["millis"] * s), DURATION, errors(a, b))
        x, y = self.number(a), self.number(b)
        # dividing by zero gives what JSON can't hold: null
        col = {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col, "/": F.try_divide(x.col, y.col), "%": F.try_mod(x.col, y.col)}[op]
        return Val(col, FLOAT, errors(x, y))


COMPILERS = {"cel": CelCompiler, "plain": PlainCompiler, "view": ViewCompiler}


def compiler(dialect: str, scope: Scope) -> Compiler:
    """The compiler of a dialect with its whole function library."""
    from folioquery import functions  # noqa: F401  registers the libraries

    return COMPILERS[dialect](scope)
