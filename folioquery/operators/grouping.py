"""Groups and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.plans.compiler import Scope, Val, compiler
from folioquery.plans.syntax import ExpressionError
from folioquery.values import as_double, canonical_json, is_empty, list_of, sort_keys

NUMERIC = {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}
TEXT = {"earliest": F.min, "latest": F.max}


@dataclass(frozen=True)
class Summary:
    name: str
    function: str
    value: Val | None


def _is_text(v: Val) -> Column:
    from folioquery.values import dynamic_kind

    if v.kind.name == "dynamic":
        return dynamic_kind(v.col) == "string"
    return F.lit(v.kind.name in ("string", "date", "timestamp"))


def summary(s: Summary, custom: dict[str, str], scope: Scope) -> Column:
    """The aggregate of a summary.

    Sums and the like skip nulls, are null over nothing, and null altogether if any value is no
    number; ``earliest`` and ``latest`` likewise for texts. ``empty`` counts null, "", [] and {}.
    """
    f, v = s.function, s.value
    if f == "count":
        return F.count(F.lit(1))
    if f in custom:
        items = F.collect_list(F.struct(v.col.alias("v")))
        values = Val(F.transform(items, lambda x: x["v"]), list_of(v.kind))
        return compiler("cel", Scope(bindings={"values": values}, timezone=scope.timezone, now=scope.now)).text(custom[f]).col
    if f in NUMERIC:
        number = as_double(v.col, v.kind)
        if v.kind.numeric:
            return NUMERIC[f](v.col)
        return F.when(F.count_if(v.col.isNotNull() & number.isNull()) == 0, NUMERIC[f](number))
    if f in TEXT:
        if v.kind.name in ("string", "date", "timestamp"):
            return TEXT[f](v.col)
        text = F.when(_is_text(v), F.try_variant_get(v.col, "$", "string") if v.kind.name == "dynamic" else v.col.cast("string"))
        return F.when(F.count_if(v.col.isNotNull() & text.isNull()) == 0, TEXT[f](text))
    if f in ("empty", "filled"):
        gone = is_empty(v.col, v.kind)
        return F.count_if(gone if f == "empty" else ~gone)
    raise ExpressionError(f"unknown summary function {f}", "invalid_query")


def grouped(df: DataFrame, keys: list[tuple[str, Val, bool]], summaries: list[Summary], custom: dict[str, str], scope: Scope) -> DataFrame:
    """One row per group with its keys, ``count`` and summaries, over all matches, in the keys' order.

    Groups are told apart by the JSON text of their keys. Without keys there is exactly one group.
    """
    names = [k for k, _, _ in keys] + [s.name for s in summaries] + ["count"]
    if len(set(names)) < len(names):
        raise ExpressionError("two summaries have one name", "invalid_query")
    aggregates = [summary(s, custom, scope).alias(s.name) for s in summaries]
    count = F.count(F.lit(1)).alias("count")
    if not keys:
        return df.agg(count, *aggregates)
    told = {f"__key_{n}": canonical_json(v.col, v.kind) for n, v, _ in keys if v.kind.name in ("dynamic", "map", "list")}
    plain = {n: v.col for n, v, _ in keys if f"__key_{n}" not in told}
    by = [c.alias(n) for n, c in {**plain, **told}.items()]
    firsts = [F.first(v.col).alias(n) for n, v, _ in keys if f"__key_{n}" in told]
    out = df.groupBy(*by).agg(count, *firsts, *aggregates)
    order = [x for n, v, desc in keys for x in sort_keys(F.col(n), v.kind, desc)]
    return out.orderBy(*order).select(*[n for n, _, _ in keys], "count", *[s.name for s in summaries])


def plain_summary(name: str, v: Val) -> Column:
    """Summaries of the older language: what is no number is skipped, and a sum of nothing is 0."""
    number = as_double(v.col, v.kind)
    name = name.lower()
    if name == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0))
    if name in ("average", "min", "max"):
        return {"average": F.avg, "min": F.min, "max": F.max}[name](number)
    if name in ("earliest", "latest"):
        return TEXT[name](v.col)
    if name in ("checked", "unchecked"):
        return F.count_if(v.col if name == "checked" else ~v.col)
    if name in ("empty", "filled"):
        gone = is_empty(v.col, v.kind, containers=False)
        return F.count_if(gone if name == "empty" else ~gone)
    if name == "unique":
        return F.count_distinct(canonical_json(v.col, v.kind))
    raise ExpressionError(f"unknown summary {name}", "invalid_expression")
