"""Number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions.registry import function, subject
from folioquery.plans.compiler import Val, errors, literal
from folioquery.values import BOOL, FLOAT, INT, NULL


def _numeric(f, whole=False):
    def run(c, target, args):
        v, _ = subject(target, args)
        v = c.number(v)
        return Val(f(v.col), INT if whole else v.kind, v.err)

    return run


function("plain view", "abs")(_numeric(F.abs))
function("plain view", "floor")(_numeric(lambda x: F.floor(x.cast("double")).cast("long"), True))
function("plain view", "ceil")(_numeric(lambda x: F.ceil(x.cast("double")).cast("long"), True))


@function("plain view", "round")
def round_(c, target, args):
    """Half away from zero; ``view`` takes digits."""
    v, rest = subject(target, args)
    v = c.number(v)
    if rest and c.grammar.name == "view":
        return Val(F.round(v.col, int(rest[0].const)), FLOAT, v.err)
    return Val(F.round(v.col).cast("long"), INT, v.err)


def _extreme(pick):
    def run(c, target, args):
        vals = [c.number(v) for v in ([target] if target is not None else []) + args]
        cols = [v.col.cast("double") for v in vals]
        known = cols[0].isNotNull()
        for x in cols[1:]:
            known = known & x.isNotNull()
        col = pick(*cols) if len(cols) > 1 else cols[0]
        whole = all(v.kind == INT for v in vals)
        col = F.when(known, col)
        return Val(col.cast("long") if whole else col, INT if whole else FLOAT, errors(*vals))

    return run


function("plain view", "min")(_extreme(F.least))
function("plain view", "max")(_extreme(F.greatest))


@function("view", "toFixed")
def to_fixed(c, target, args):
    """Text with a fixed number of digits, halves to even."""
    from folioquery.values import STRING

    v, rest = subject(target, args)
    digits = int(rest[0].const) if rest else 0
    v = c.number(v)
    return Val(F.format_string(f"%.{digits}f", F.bround(v.col, digits)), STRING, v.err)


@function("plain view", "number")
def number(c, target, args):
    v, _ = subject(target, args)
    if v.kind == BOOL:
        return Val(v.col.cast("long"), INT, v.err)
    if v.kind.name in ("date", "timestamp"):
        return Val((F.unix_micros(v.col.cast("timestamp")) / 1000).cast("long"), INT, v.err)
    if v.kind.numeric:
        return v
    col = v.col.cast("string")
    epoch = (F.unix_micros(F.try_to_timestamp(col)) / 1000).cast("double")
    return Val(F.coalesce(F.trim(col).try_cast("double"), epoch if c.grammar.name == "plain" else F.lit(None)), FLOAT, v.err)


@function("cel", "int")
def cel_int(c, target, args):
    v = args[0]
    col = v.col.try_cast("long") if v.kind.name == "string" else v.col.cast("double").try_cast("long")
    return c.strict(col, INT, v)


@function("cel", "double")
def cel_double(c, target, args):
    return c.strict(args[0].col.try_cast("double"), FLOAT, args[0])


@function("view", "random")
def random(c, target, args):
    """A constant, so that a view is the same on every run."""
    return literal(0.5)


@function("plain", "default", "coalesce")
def default(c, target, args):
    v, rest = subject(target, args)
    a, b = c.like(v, rest[0])
    return Val(F.coalesce(a.col, b.col), b.kind if a.kind == NULL else a.kind, a.err)


@function("plain view", "if")
def if_(c, target, args):
    return c.choose(args[0], args[1], args[2] if len(args) > 2 else literal(None))


@function("plain", "exists")
def exists(c, target, args):
    return Val(args[0].col.isNotNull(), BOOL, args[0].err)
