"""Lists: macros with a bound name, and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions.registry import function, macro, subject
from folioquery.plans.compiler import Val, errors, literal
from folioquery.plans.syntax import ExpressionError, Member, Name
from folioquery.values import BOOL, FLOAT, INT, NULL, STRING, Kind, as_double, list_of


def _source(c, node) -> Val:
    v = c.compile(node.target)
    if v.kind.name != "list":
        return Val(F.lit(None).cast("array<string>"), list_of(STRING), v.err)
    return v


def _body(c, node, items: Val):
    """The names and tree of a macro's body: ``x, expr`` or, in two dialects, ``expr`` over value and index."""
    if len(node.args) == 2 and isinstance(node.args[0], Name):
        return node.args[0].id, node.args[1]
    if len(node.args) == 1 and c.grammar.name != "cel":
        return "value", node.args[0]
    return None, None


def _each(c, name: str, tree, items: Val):
    def run(x, i=None):
        bound = {name: Val(x, items.kind.item)}
        if i is not None and c.grammar.name != "cel":
            bound["index"] = Val(i.cast("long"), INT)
        return c.within(c.scope.bind(**bound)).compile(tree)

    return run


def _predicate(higher):
    def run(c, node):
        items = _source(c, node)
        name, tree = _body(c, node, items)
        if name is None:
            return None
        each = _each(c, name, tree, items)
        return Val(higher(items.col, lambda x: c.truth(each(x))), BOOL, items.err)

    return run


macro("cel plain", "all")(_predicate(F.forall))
macro("cel plain", "exists")(_predicate(F.exists))
macro("cel plain", "exists_one")(_predicate(lambda a, f: F.size(F.filter(a, f)) == 1))


@macro("cel plain view", "filter")
def filter_(c, node):
    items = _source(c, node)
    name, tree = _body(c, node, items)
    if name is None:
        return None
    each = _each(c, name, tree, items)
    return Val(F.filter(items.col, lambda x, i: F.coalesce(c.truth(each(x, i)), F.lit(False))), items.kind, items.err)


@macro("cel plain view", "map")
def map_(c, node):
    items = _source(c, node)
    if len(node.args) == 3:  # filtered map
        keep = F.filter(items.col, lambda x: F.coalesce(c.truth(_each(c, node.args[0].id, node.args[1], items)(x)), F.lit(False)))
        items = Val(keep, items.kind, items.err)
        name, tree = node.args[0].id, node.args[2]
    else:
        name, tree = _body(c, node, items)
    if name is None:
        return None
    each = _each(c, name, tree, items)
    kind = each(F.lit(None), F.lit(0)).kind
    return Val(F.transform(items.col, lambda x, i: each(x, i).col), list_of(kind), items.err)


@macro("plain view", "reduce")
def reduce(c, node):
    """``list.reduce(expr over acc and value, start)``."""
    items = _source(c, node)
    tree, start = node.args[0], c.compile(node.args[1])
    kind = FLOAT if start.kind.numeric else start.kind

    def step(acc, x):
        v = c.within(c.scope.bind(acc=Val(acc, kind), value=Val(x, items.kind.item))).compile(tree)
        return v.col.cast("double") if kind == FLOAT else v.col

    first = start.col.cast("double") if kind == FLOAT else start.col
    return Val(F.aggregate(items.col, first, step), kind, errors(items, start))


@macro("cel plain", "has")
def has(c, node):
    """Whether a member is there; for dynamic values also if it is null."""
    if len(node.args) != 1:
        raise ExpressionError("has takes one member", "wrong_argument_count")
    arg = node.args[0]
    if isinstance(arg, Member):
        bound = c.scope.bindings.get(arg.target.id) if isinstance(arg.target, Name) else None
        if isinstance(bound, dict):
            v = bound.get(arg.name)
            return literal(False) if v is None else Val(v.col.isNotNull(), BOOL)
        v = c.compile(arg.target)
        if v.kind.name == "dynamic":
            return Val(F.coalesce(F.array_contains(F.json_object_keys(F.to_json(v.col)), arg.name), F.lit(False)), BOOL)
        if v.kind.name == "map" and not v.kind.fields:
            return Val(F.coalesce(F.map_contains_key(v.col, arg.name), F.lit(False)), BOOL)
    return Val(c.compile(arg).col.isNotNull(), BOOL)


@function("plain view", "hasProperty")
def has_property(c, target, args):
    name = args[0].const
    return Val(F.lit(name in c.scope.fields), BOOL)


@function("plain view", "join")
def join(c, target, args):
    v, rest = subject(target, args)
    sep = str(rest[0].const) if rest else "," if c.grammar.name == "plain" else ""
    shown = F.transform(v.col, lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return Val(F.array_join(shown, sep), STRING, v.err)


@function("plain view", "sort")
def sort(c, target, args):
    v, _ = subject(target, args)
    return Val(F.array_sort(v.col), v.kind, v.err)


@function("plain view", "unique")
def unique(c, target, args):
    v, _ = subject(target, args)
    return Val(F.array_distinct(v.col), v.kind, v.err)


@function("plain view", "flat")
def flat(c, target, args):
    v, _ = subject(target, args)
    if v.kind.item and v.kind.item.name == "list":
        return Val(F.flatten(v.col), v.kind.item, v.err)
    return v


@function("plain view", "first")
def first(c, target, args):
    v, _ = subject(target, args)
    return Val(F.get(v.col, F.lit(0)), v.kind.item or NULL, v.err)


@function("plain view", "last")
def last(c, target, args):
    v, _ = subject(target, args)
    return Val(F.try_element_at(v.col, F.lit(-1)), v.kind.item or NULL, v.err)


@function("plain view", "list")
def list_(c, target, args):
    v, _ = subject(target, args)
    return v if v.kind.name == "list" else Val(F.array(v.col), list_of(v.kind), v.err)


def _total(c, target, args):
    v, _ = subject(target, args)
    item = v.kind.item or NULL
    return Val(F.aggregate(v.col, F.lit(0.0), lambda a, x: a + F.coalesce(as_double(x, item), F.lit(0.0))), FLOAT, v.err), v


@function("cel view", "sum")
def sum_(c, target, args):
    return _total(c, target, args)[0]


@function("cel view", "mean")
def mean(c, target, args):
    total, v = _total(c, target, args)
    return Val(F.try_divide(total.col, F.size(v.col).cast("double")), FLOAT, v.err)


@function("plain view", "keys")
def keys(c, target, args):
    v, _ = subject(target, args)
    if v.kind.fields:
        return Val(F.array(*[F.lit(k) for k, _ in v.kind.fields]), list_of(STRING), v.err)
    col = F.json_object_keys(F.to_json(v.col)) if v.kind.name == "dynamic" else F.map_keys(v.col)
    return Val(col, list_of(STRING), v.err)


@function("plain view", "values")
def values(c, target, args):
    v, _ = subject(target, args)
    if v.kind.fields:
        parts = [Val(v.col[k], kind) for k, kind in v.kind.fields]
        same = {p.kind for p in parts}
        return Val(F.array(*[p.col if len(same) == 1 else p.col.cast("string") for p in parts]), list_of(same.pop() if len(same) == 1 else STRING), v.err)
    return Val(F.map_values(v.col), list_of(v.kind.item or Kind("dynamic")), v.err)
