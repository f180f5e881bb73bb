"""Text functions. Lengths are bytes in ``plain`` and code points in ``view`` and ``cel``."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioquery.functions.registry import function, subject, text_of
from folioquery.plans.compiler import Val, errors, literal
from folioquery.plans.syntax import Regex
from folioquery.values import BOOL, DYNAMIC, INT, NULL, STRING, is_empty, list_of

#: White space in the sense of Unicode.
WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _simple(f):
    def run(c, target, args):
        v, rest = subject(target, args)
        v = text_of(c, v)
        return Val(f(v.col, *[text_of(c, a).col for a in rest]), STRING, errors(v, *rest))

    return run


def _test(f):
    def run(c, target, args):
        v, rest = subject(target, args)
        v = text_of(c, v)
        if v.kind.name == "list" and f is F.contains:
            return c.contains(v, rest[0])
        return Val(F.coalesce(f(v.col, text_of(c, rest[0]).col), F.lit(False)), BOOL, errors(v, *rest))

    return run


function("cel plain view", "lower", "lowerAscii")(_simple(F.lower))
function("plain", "upper")(_simple(F.upper))
function("plain view", "trim")(_simple(lambda s: F.regexp_replace(s, f"^{WHITE}|{WHITE}\\z", "")))
function("plain", "trimStart")(_simple(lambda s: F.regexp_replace(s, f"^{WHITE}", "")))
function("plain", "trimEnd")(_simple(lambda s: F.regexp_replace(s, f"{WHITE}\\z", "")))
function("cel plain view", "contains")(_test(F.contains))
function("cel plain view", "startsWith")(_test(F.startswith))
function("cel plain view", "endsWith")(_test(F.endswith))
function("view", "title")(_simple(F.initcap))
function("plain", "title")(_simple(lambda s: F.initcap(F.regexp_replace(F.trim(s), r"\s+", " "))))
function("plain", "slugify")(_simple(lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")))
function("view", "escapeHTML", "html")(
    _simple(lambda s: F.replace(F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")))
)
function("view", "image", "icon")(_simple(lambda s, *_: s))


def _fold(joined):
    def run(c, target, args):
        parts = [c.functions["contains"](c, target, [a]) for a in args]
        col = parts[0].col
        for p in parts[1:]:
            col = joined(col, p.col)
        return Val(col, BOOL, errors(*parts))

    return run


function("plain view", "containsAll")(_fold(lambda a, b: a & b))
function("plain view", "containsAny")(_fold(lambda a, b: a | b))


@function("cel plain view", "matches")
def matches(c, target, args):
    if target is not None and isinstance(target.const, Regex):  # /re/.matches(text)
        target, args = args[0], [target]
    v, rest = subject(target, args)
    return Val(F.coalesce(F.rlike(text_of(c, v).col, rest[0].col), F.lit(False)), BOOL, errors(v, *rest))


@function("plain view", "replace")
def replace(c, target, args):
    v, (old, new) = subject(target, args)
    err = errors(v, old, new)
    if isinstance(old.const, Regex):
        every = "g" in old.const.flags
        pattern = old.col if every else F.concat(F.lit("(?s)\\A(.*?)"), old.col)
        value = new.col if every else F.concat(F.lit("$1"), new.col)
        return Val(F.regexp_replace(v.col, pattern, value), STRING, err)
    return Val(F.replace(v.col, old.col, new.col), STRING, err)


@function("plain view", "split")
def split(c, target, args):
    v, rest = subject(target, args)
    limit = int(rest[1].const) if len(rest) > 1 else -1
    pattern = rest[0].const.pattern if isinstance(rest[0].const, Regex) else re.escape(str(rest[0].const))
    return Val(F.split(text_of(c, v).col, pattern, limit), list_of(STRING), errors(v, *rest))


@function("plain view", "repeat")
def repeat(c, target, args):
    v, rest = subject(target, args)
    return Val(F.repeat(text_of(c, v).col, rest[0].col.cast("int")), STRING, errors(v, *rest))


@function("plain view", "reverse")
def reverse(c, target, args):
    v, _ = subject(target, args)
    return Val(F.reverse(v.col), v.kind, v.err)


@function("plain view", "slice")
def slice_(c, target, args):
    """Negative places count from the end; everything is clamped."""
    v, rest = subject(target, args)
    size = F.size(v.col) if v.kind.name == "list" else F.char_length(v.col)

    def place(col):
        return F.greatest(F.lit(0), F.least(size, F.when(col < 0, size + col).otherwise(col))).cast("int")

    start = place(rest[0].col.cast("int"))
    end = place(rest[1].col.cast("int")) if len(rest) > 1 else size
    n = F.greatest(F.lit(0), end - start)
    col = F.slice(v.col, start + 1, n) if v.kind.name == "list" else F.substring(v.col, start + 1, n)
    return Val(col, v.kind, errors(v, *rest))


def _size(c, target, args):
    v, _ = subject(target, args)
    if v.kind.name == "list" or (v.kind.name == "map" and v.kind.item is not None):
        return Val(F.size(v.col).cast("long"), INT, v.err)
    if v.kind.name == "map":
        return Val(F.lit(len(v.kind.fields)).cast("long"), INT, v.err)
    v = text_of(c, v)
    return Val((F.octet_length(v.col) if c.grammar.name == "plain" else F.char_length(v.col)).cast("long"), INT, v.err)


function("cel plain view", "size", "length")(_size)


@function("plain view", "isEmpty")
def empty(c, target, args):
    v, _ = subject(target, args)
    return Val(is_empty(v.col, v.kind), BOOL, v.err)


@function("plain view", "isTruthy")
def truthy(c, target, args):
    v, _ = subject(target, args)
    return Val(c.truth(v), BOOL, v.err)


@function("plain view", "toString")
def to_string(c, target, args):
    v, _ = subject(target, args)
    if v.kind.name in ("list", "map", "dynamic"):
        return Val(F.to_json(v.col), STRING, v.err)
    return Val(c.shown(v) if c.grammar.name == "view" else v.col.cast("string"), STRING, v.err)


@function("cel", "string")
def cel_string(c, target, args):
    return Val(args[0].col.cast("string"), STRING, args[0].err)


@function("plain view", "isType")
def is_type(c, target, args):
    v, rest = subject(target, args)
    names = {"int": "number", "float": "number", "bool": "boolean", "map": "object"}
    return Val(v.col.isNotNull() & F.lit(names.get(v.kind.name, v.kind.name) == rest[0].const), BOOL, errors(v))


@function("cel", "type")
def type_of(c, target, args):
    v = args[0]
    names = {"float": "double", "null": "null_type", "timestamp": "google.protobuf.Timestamp", "duration": "google.protobuf.Duration"}
    return literal(names.get(v.kind.name, v.kind.name)) if v.kind not in (DYNAMIC, NULL) else literal("dyn")
