"""The older query object: folder, string or nested filters, formulas, one group key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.operators.grouping import plain_summary
from folioquery.operators.paging import enum_order
from folioquery.plans.compiler import Scope, Val, clock, compiler
from folioquery.plans.syntax import PLAIN, ExpressionError, in_order, parse, references
from folioquery.values import NULL


@dataclass
class PlainOutcome:
    results: DataFrame
    groups: DataFrame | None
    summaries: DataFrame | None
    matches: DataFrame


def condition(c, where) -> Column:
    """A filter text, or an object: the first of ``and``, ``or``, ``not`` that is there; anything else is false."""
    if isinstance(where, str):
        try:
            v = c.text(where)
        except ExpressionError as e:
            if e.code == "unknown_function" and "::" in where:
                return F.lit(False)  # an extension that isn't registered matches nothing
            raise
        kept = c.truth(v)
        return kept if v.err is None else kept & v.err.isNull()
    if isinstance(where, dict):
        if "and" in where:
            out = F.lit(True)
            for x in where["and"]:
                out = out & condition(c, x)
            return out
        if "or" in where:
            out = F.lit(False)
            for x in where["or"]:
                out = out | condition(c, x)
            return out
        if "not" in where:
            inner = where["not"]
            return ~condition(c, inner)
    return F.lit(False)


def run_plain_query(records: Records, query: dict, *, this: dict[str, Val] | None = None, enums: dict[str, list[str]] | None = None) -> PlainOutcome:
    """Compile an older query. Nulls flow, truthiness decides, groups ignore the page."""
    scope = Scope(dict(records.fields), {**records.bindings(), **({"this": this} if this else {})}, query.get("timezone", "UTC"), query.get("now") or clock())
    df = records.df
    if query.get("types"):
        df = df.where(records.has_type(query["types"]))
    if query.get("folder"):
        df = df.where(F.startswith(records.path, F.lit(query["folder"].rstrip("/") + "/")))
    trees = {k: parse(s, PLAIN) for k, s in query.get("formulas", {}).items()}
    formulas: dict[str, Val] = {}
    for k in in_order({k: references(t, "formula") for k, t in trees.items()}):
        formulas[k] = compiler("plain", scope.bind(formula=formulas)).compile(trees[k])
    c = compiler("plain", scope.bind(formula=formulas))
    if "where" in query:
        strict = compiler("plain", c.scope)
        strict.joins_text = False
        df = df.where(condition(strict, query["where"]))

    def value(name: str) -> Val:
        head, _, rest = name.partition(".")
        if head == "formula":
            return formulas.get(rest, Val(F.lit(None), NULL))
        if head == "file":
            return records.bindings()["file"].get(rest, Val(F.lit(None), NULL))
        return records.fields.get(name, Val(F.lit(None).cast("string"), NULL))

    order = []
    for item in query.get("order_by", []):
        name = item["field"] if isinstance(item, dict) else item
        v = value(name)
        key = enum_order(v.col, enums[name]) if enums and name in enums else v.col
        desc = isinstance(item, dict) and item.get("direction", "asc") == "desc"
        order.append(key.desc_nulls_first() if desc else key.asc_nulls_last())
    order.append(records.path.asc())
    shown = {**{k: v.col for k, v in records.fields.items()}, **{k: v.col for k, v in formulas.items()}}
    out = df.orderBy(*order)
    groups = None
    if "groupBy" in query:
        g = query["groupBy"]
        v = value(g["property"])
        key = v.col.cast("string")  # keys sort as text: "10" before "2"
        desc = g.get("direction", "ASC").upper() == "DESC"
        paths = F.sort_array(F.collect_list(records.path))
        groups = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("count"), paths.alias("paths"))
        groups = groups.orderBy(F.col("value").desc_nulls_first() if desc else F.col("value").asc_nulls_last())
    else:
        if query.get("offset"):
            out = out.offset(query["offset"])
        if query.get("limit") is not None:
            out = out.limit(query["limit"])
    summaries = None
    if wanted := query.get("property_summaries"):
        custom = query.get("summaries", {})
        cols = []
        for name, f in wanted.items():
            v = value(name)
            if f in custom:
                from folioquery.values import list_of

                values = Val(F.collect_list(v.col), list_of(v.kind))
                cols.append(compiler("plain", Scope(bindings={"values": values})).text(custom[f]).col.alias(name))
            else:
                cols.append(plain_summary(f, v).alias(name))
        summaries = df.agg(*cols)
    for k in shown:
        if k == "path":
            raise ExpressionError("a formula can't be named path", "invalid_formula")
    return PlainOutcome(out.select(records.path.alias("path"), *[x.alias(n) for n, x in shown.items()]), groups, summaries, df)
