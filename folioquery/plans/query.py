"""The canonical query object and its lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.operators.grouping import Summary, grouped
from folioquery.plans.compiler import Scope, Val, clock, compiler
from folioquery.plans.hops import Hops
from folioquery.plans.syntax import CEL, ExpressionError, Name, children, in_order, parse, references
from folioquery.values import sort_keys

KEYS = {
    "types", "timezone", "context", "projections", "where", "select", "order_by", "group_by", "summary_functions",
    "summaries", "limit", "offset", "include_body", "frontmatter_mode", "output", "now",
}


@dataclass
class Outcome:
    """Results, groups and diagnostics as lazy frames; counts on demand."""

    results: DataFrame
    matches: DataFrame
    groups: DataFrame | None
    diagnostics: DataFrame
    order: list[Column] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    def total_count(self) -> int:
        return self.matches.count()

    def has_more(self) -> bool:
        return self.limit is not None and self.total_count() > self.offset + self.limit


def output_name(item: dict | str) -> str:
    if isinstance(item, dict):
        return item["name"] if "name" in item else item["field"].rsplit(".", 1)[-1]
    return item.rsplit(".", 1)[-1]


def roots(node) -> set[str]:
    """Names that stand free in a tree."""
    own = {node.id} if isinstance(node, Name) else set()
    return own.union(*(roots(c) for c in children(node)))


def run_query(records: Records, query: dict, *, this: dict[str, Val] | None = None, targets: Records | None = None) -> Outcome:
    """Compile a query object over records; nothing runs until a frame is used.

    Keys as in KEYS; those that start with ``x-`` are ignored, others refused. ``where`` keeps
    only true; a row whose expression fails gets null there and a row in ``diagnostics``.
    Links followed with ``asFile()`` lead to ``targets``, or to the records themselves.
    """
    for k in query:
        if k not in KEYS and not k.startswith("x-"):
            raise ExpressionError(f"unknown key {k}", "invalid_query")
    if query.get("include_body") and query.get("output") == "metadata":
        raise ExpressionError("metadata output has no body", "invalid_query")
    for k in ("limit", "offset"):
        if k in query and (not isinstance(query[k], int) or query[k] < 0):
            raise ExpressionError(f"{k} must be a whole number", "invalid_query")
    scope = Scope(dict(records.fields), records.bindings(), query.get("timezone", "UTC"), query.get("now") or clock())
    if this is not None:
        scope = scope.bind(this=this)
    df = records.df
    problems: list[tuple[str, str, Column]] = []

    if query.get("types"):
        df = df.where(records.has_type(query["types"]))
    # With the general plan, records that could not be read are left out.
    if records.invalid is not None and set(query) - {"order_by", "limit", "offset", "timezone", "types", "output"}:
        df = df.where(records.invalid.isNull())

    def evaluate(context: str, name: str, v: Val) -> Val:
        if v.err is not None:
            problems.append((context, name, v.err))
        return v

    projections = query.get("projections", {})
    sources = {k: p["expr"] if isinstance(p, dict) else p for k, p in projections.items()}
    trees = {k: parse(s, CEL) for k, s in sources.items()}
    where = parse(query["where"], CEL) if "where" in query else None
    picked = [parse(i["expr"], CEL) if isinstance(i, dict) and "expr" in i else None for i in query.get("select", [])]
    hops = Hops(records, targets or records, df, [t for t in (*trees.values(), where, *picked) if t is not None])
    projected: dict[str, Val] = {}
    for k in in_order({k: references(t, "projection") for k, t in trees.items()}):
        inner = scope.bind(projection=projected)
        tree = hops.lower(trees[k], inner)
        v = compiler("cel", inner.bind(**hops.bound)).compile(tree)
        projected[k] = evaluate("query_projection", f"projections.{k}", v)
    scope = scope.bind(projection=projected)
    where = hops.lower(where, scope)
    picked = [hops.lower(t, scope) for t in picked]
    cel, df = compiler("cel", scope.bind(**hops.bound)), hops.df

    before = df
    if where is not None:
        v = evaluate("query_filter", "where", cel.compile(where))
        df = df.where(cel.truth(v))

    names = [output_name(i) for i in query.get("select", [])]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ExpressionError(f"two outputs are named {sorted(twice)[0]}", "invalid_query")
    chosen: dict[str, Val] = {}
    for item, name, tree in zip(query.get("select", []), names, picked, strict=True):
        if tree is not None:
            chosen[name] = evaluate("query_selection", f"select.{name}", cel.compile(tree))
        else:
            chosen[name] = lookup(item["field"] if isinstance(item, dict) else item, records, projected, chosen)

    order: list[Column] = []
    for item in query.get("order_by", []):
        v = order_value(item["field"], records, projected, chosen)
        order += sort_keys(v.col, v.kind, item.get("direction", "asc") == "desc")
    order.append(records.path.asc())

    limit, offset = query.get("limit"), query.get("offset", 0)
    # One projection is carried, so the sort sees only what is returned.
    shown = dict(chosen) if "select" in query else {k: v for k, v in records.fields.items()}
    if query.get("frontmatter_mode") == "persisted" and "select" not in query:
        shown = dict(records.raw)
    if query.get("include_body") and "body" in records.file:
        shown["body"] = records.file["body"]
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    out = out.select(records.path.alias("path"), *[v.col.alias(n) for n, v in shown.items() if n != "path"])

    groups = None
    if "group_by" in query or "summaries" in query:
        keys = []
        for g in query.get("group_by", []):
            g = {"field": g} if isinstance(g, str) else g
            v = order_value(g["field"], records, projected, chosen)
            keys.append((output_name(g), v, g.get("direction", "asc") == "desc"))
        summaries = []
        for s in query.get("summaries", []):
            v = order_value(s["field"], records, projected, chosen) if "field" in s else None
            summaries.append(Summary(s.get("name") or f"{output_name(s['field']) if 'field' in s else 'rows'}_{s['function']}", s["function"], v))
        groups = grouped(df, keys, summaries, query.get("summary_functions", {}), scope)

    diagnostics = None
    for context, name, err in problems:
        part = before.where(err.isNotNull()).select(
            records.path.alias("path"),
            F.lit("warning").alias("severity"),
            F.lit("expression_evaluation_error").alias("code"),
            err.alias("message"),
            F.lit(context).alias("context"),
            F.lit(name).alias("field"),
        )
        diagnostics = part if diagnostics is None else diagnostics.unionByName(part)
    if diagnostics is None:
        diagnostics = df.sparkSession.createDataFrame([], "path string, severity string, code string, message string, context string, field string")
    return Outcome(out, df, groups, diagnostics, order, limit, offset)


def lookup(name: str, records: Records, projected: dict[str, Val], chosen: dict[str, Val]) -> Val:
    """A selected field: a projection, a file fact, an earlier output, else an effective field."""
    head, _, rest = name.partition(".")
    if head == "projection":
        if rest not in projected:
            raise ExpressionError(f"unknown projection {rest}", "invalid_query")
        return projected[rest]
    if head == "file":
        facts = records.bindings()["file"]
        return facts.get(rest, Val(F.lit(None), _null()))
    if name in chosen:
        return chosen[name]
    if name in records.fields:
        return records.fields[name]
    if rest and head in records.fields:
        from folioquery.plans.compiler import CelCompiler

        v = records.fields[head]
        for part in rest.split("."):
            v = CelCompiler(Scope()).member(v, part, True)
        return v
    return Val(F.lit(None), _null())


def order_value(name: str, records: Records, projected: dict[str, Val], chosen: dict[str, Val]) -> Val:
    """Order and group fields: as ``lookup``, but a plain name is a literal top-level key."""
    if name.split(".")[0] in ("projection", "file"):
        return lookup(name, records, projected, chosen)
    return chosen.get(name) or records.fields.get(name) or Val(F.lit(None).cast("string"), _null())


def _null():
    from folioquery.values import NULL

    return NULL
