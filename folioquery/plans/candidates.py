"""Candidate predicates: what a provider may test early without losing a match.

A canonical filter is folded to the conditions that every match must meet. Parts that
can't be decided from stored columns are unknown and keep the row; the
exact filter is applied to what is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.plans.syntax import Binary, Call, ListLit, Lit, Member, Name, Unary, parse
from folioquery.values import DYNAMIC

_COMPARE = {"==": "==", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def safe_literal(value: object) -> bool:
    """Whether stored text equals the value only if the values are equal: texts that look like numbers, dates or constants may not."""
    if isinstance(value, bool):
        return True
    if not isinstance(value, str):
        return False
    return not re.fullmatch(r"\s*|[-+]?\.?\d.*|true|false|yes|no|on|off|null|~|\.inf|\.nan", value, flags=re.I)


def _field(node) -> str | None:
    if isinstance(node, Name):
        return node.id
    if isinstance(node, Member) and node.target == Name("record"):
        return node.name
    return None


def candidate(records: Records, where: str) -> Column | None:
    """A condition that holds for every record the filter keeps, or None if nothing is known."""
    return _necessary(parse(where), records, True)


def _necessary(node, records: Records, positive: bool) -> Column | None:
    if isinstance(node, Unary) and node.op == "!":
        return _necessary(node.operand, records, not positive)
    if isinstance(node, Binary) and node.op in ("&&", "||"):
        parts = [_necessary(x, records, positive) for x in (node.left, node.right)]
        both = (node.op == "&&") == positive
        if both:  # either part alone is still necessary
            known = [p for p in parts if p is not None]
            return None if not known else known[0] if len(known) == 1 else known[0] & known[1]
        return None if any(p is None for p in parts) else parts[0] | parts[1]
    leaf = _leaf(node, records)
    if leaf is None:
        return None
    # an unknown truth value keeps the row
    return F.coalesce(leaf if positive else ~leaf, F.lit(True))


def _leaf(node, records: Records) -> Column | None:
    if isinstance(node, Lit) and isinstance(node.value, bool):
        return F.lit(node.value)
    if isinstance(node, Call) and isinstance(node.target, Name) and node.target.id == "file" and node.name == "inFolder" and isinstance(node.args[0], Lit):
        want = str(node.args[0].value).strip("/")
        folder = records.file["folder"].col
        return (folder == want) | (F.startswith(folder, F.lit(want + "/")) if want else F.lit(False))
    if not isinstance(node, Binary):
        return None
    left, right, op = node.left, node.right, node.op
    if isinstance(left, Lit) and op in _FLIP:
        left, right, op = right, left, _FLIP[op]
    name = _field(left)
    if name is None or name not in records.fields:
        return None
    v = records.fields[name]
    if op == "in" and isinstance(right, ListLit) and all(isinstance(x, Lit) for x in right.items):
        values = [x.value for x in right.items]
        if v.kind == DYNAMIC and not all(map(safe_literal, values)):
            return None
        column = F.try_variant_get(v.col, "$", "string") if v.kind == DYNAMIC else v.col
        return column.isin(values)
    if op not in _COMPARE or not isinstance(right, Lit) or right.value is None:
        return None
    if v.kind == DYNAMIC:  # only equality with a text that can be nothing else
        if op != "==" or not safe_literal(right.value):
            return None
        return F.try_variant_get(v.col, "$", "string") == str(right.value)
    if v.kind.name not in ("int", "float", "string", "bool"):
        return None
    if (v.kind.name == "string") != isinstance(right.value, str):
        return None
    x, y = v.col, F.lit(right.value)
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
