"""Saved views: view files with filters and formulas, and canonical views merged into queries."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.plans.compiler import Scope, Val, clock, compiler
from folioquery.plans.query import Outcome, run_query
from folioquery.plans.syntax import VIEW, ExpressionError, in_order, parse, references
from folioquery.values import NULL, canonical_json


@dataclass
class ViewOutcome:
    results: DataFrame
    groups: DataFrame | None
    matches: DataFrame


def condition(c, node) -> Column:
    """A filter: a text, or ``and``, ``or`` and ``not`` that hold together. An empty ``or`` is false; ``not`` is none of."""
    if node is None:
        return F.lit(True)
    if isinstance(node, str):
        return c.truth(c.text(node))
    if isinstance(node, list):
        node = {"and": node}
    out = F.lit(True)
    for x in node.get("and") or []:
        out = out & condition(c, x)
    if "or" in node:
        any_ = F.lit(False)
        for x in node["or"] or []:
            any_ = any_ | condition(c, x)
        out = out & any_
    for x in node.get("not") or []:
        out = out & ~condition(c, x)
    return out


def run_view(records: Records, document: str | dict, name: str, *, now: str | None = None, timezone: str = "UTC") -> ViewOutcome:
    """Run the view of a name in a view file: shared and own filters, formulas, sort with null greatest, and group counts."""
    doc = yaml.safe_load(document) if isinstance(document, str) else document
    found = [v for v in doc.get("views", []) if v.get("name") == name]
    if not found:
        raise ExpressionError(f"no view {name}", "view_not_found")
    view = found[0]
    scope = Scope(dict(records.fields), records.bindings(), timezone, now or clock())
    trees = {k: parse(str(s), VIEW) for k, s in (doc.get("formulas") or {}).items()}
    formulas: dict[str, Val] = {}
    for k in in_order({k: references(t, "formula") for k, t in trees.items()}):
        formulas[k] = compiler("view", scope.bind(formula=formulas)).compile(trees[k])
    c = compiler("view", scope.bind(formula=formulas))
    df = records.df.where(condition(c, doc.get("filters"))).where(condition(c, view.get("filters")))

    def value(prop: str) -> Val:
        head, _, rest = prop.partition(".")
        if head == "formula":
            return formulas.get(rest, Val(F.lit(None), NULL))
        if head == "file":
            return records.bindings()["file"].get(rest, Val(F.lit(None), NULL))
        return records.fields.get(rest if head == "note" else prop, Val(F.lit(None).cast("string"), NULL))

    order: list[Column] = []
    for s in view.get("sort") or []:
        v = value(s["property"])
        key = v.col if v.kind.name not in ("list", "map", "dynamic") else canonical_json(v.col, v.kind)
        order.append(key.desc_nulls_first() if str(s.get("direction", "ASC")).upper() == "DESC" else key.asc_nulls_last())
    out = df.orderBy(*order, records.path.asc())
    if view.get("limit") is not None:
        out = out.limit(int(view["limit"]))
    columns = view.get("order") or [*records.fields, *(f"formula.{k}" for k in formulas)]
    shown = {p.rsplit(".", 1)[-1]: value(p).col for p in columns}
    groups = None
    if g := view.get("groupBy"):
        g = {"property": g} if isinstance(g, str) else g
        v = value(g["property"])
        groups = df.groupBy(canonical_json(v.col, v.kind).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        groups = groups.orderBy(F.col("value").desc() if str(g.get("direction", "ASC")).upper() == "DESC" else F.col("value").asc())
    return ViewOutcome(out.select(records.path.alias("path"), *[x.alias(n) for n, x in shown.items() if n != "path"]), groups, df)


def merge(shared: dict, view: dict) -> dict:
    """A canonical view's query: both filters hold, projections join (a clash is refused), the view's other keys win."""
    out = {**shared, **{k: v for k, v in view.items() if k not in ("name", "id", "where", "projections")}}
    wheres = [q["where"] for q in (shared, view) if "where" in q]
    if wheres:
        out["where"] = " && ".join(f"({w})" for w in wheres)
    a, b = shared.get("projections", {}), view.get("projections", {})
    if clash := sorted(set(a) & set(b)):
        raise ExpressionError(f"projection {clash[0]} is given twice", "invalid_view")
    if a or b:
        out["projections"] = {**a, **b}
    if "types" in shared and "types" in view:
        out["types"] = [t for t in view["types"] if t in shared["types"]]
    return out


def run_saved(records: Records, document: dict, name: str) -> Outcome:
    found = [v for v in document.get("views", []) if v.get("name") == name]
    if not found:
        raise ExpressionError(f"no view {name}", "view_not_found")
    return run_query(records, merge(document.get("query", {}), found[0].get("query", {k: v for k, v in found[0].items() if k not in ("name", "id")})))
