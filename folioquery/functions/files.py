"""Folders, tags and links of a record's file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.functions.registry import function, subject
from folioquery.plans.compiler import Val, errors, literal
from folioquery.values import BOOL, STRING


def _member(c, v: Val, name: str) -> Val:
    """A member of a file, which may be bound as a dict of values."""
    return v.const.get(name, literal(None)) if isinstance(v.const, dict) else c.member(v, name, True)


@function("cel plain view", "inFolder")
def in_folder(c, target, args):
    """In a folder or below it; "" is the root alone."""
    folder = _member(c, target, "folder").col
    want = F.regexp_replace(args[0].col, "^/+|/+$", "")
    return Val((folder == want) | ((want != "") & F.startswith(folder, F.concat(want, F.lit("/")))), BOOL, args[0].err)


def _below(want: Column):
    return lambda t: (t == want) | F.startswith(t, F.concat(want, F.lit("/")))


@function("cel plain view", "hasTag")
def has_tag(c, target, args):
    """Any of the tags, or a tag below it: a/b is an a."""
    tags = _member(c, target, "tags")
    found = None
    for a in args:
        one = F.exists(tags.col, _below(F.regexp_replace(a.col, "^#", "")))
        found = one if found is None else found | one
    return Val(F.coalesce(found, F.lit(False)), BOOL, errors(*args))


@function("cel plain view", "hasLink")
def has_link(c, target, args):
    """Whether a link of the record is resolved to the path (or written as it)."""
    want = F.regexp_replace(args[0].col.cast("string"), r"^\[\[|\]\]$", "")
    links = _member(c, target, "links")
    return Val(F.coalesce(F.exists(links.col, lambda x: F.regexp_replace(x, r"^\[\[|\]\]$", "") == want), F.lit(False)), BOOL, errors(*args))


@function("cel plain view", "link", "asLink")
def link(c, target, args):
    if target is None:
        v = args[0]
        shown = F.concat(F.lit("|"), args[1].col) if len(args) > 1 else F.lit("")
        return Val(F.concat(F.lit("[["), v.col, shown, F.lit("]]")), STRING, errors(*args))
    v, _ = subject(_member(c, target, "path") if isinstance(target.const, dict) else target, [])
    return Val(F.concat(F.lit("[["), v.col, F.lit("]]")), STRING, v.err)
