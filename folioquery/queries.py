"""The registered queries over the given tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import diff, links, paging, quality
from folioquery.operators.frame import Records, from_table, path_facts
from folioquery.operators.types import Field, TypeDef, classify, with_coercion, with_computed, with_defaults
from folioquery.plans.compiler import Scope, Val, compiler
from folioquery.plans.plain_query import run_plain_query
from folioquery.plans.query import run_query
from folioquery.plans.views import run_saved, run_view
from folioquery.streaming import events as ev
from folioquery.values import DYNAMIC, STRING, kind_of, list_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "part": ("p_partkey",), "events": ("event_id",), "supplier": ("s_suppkey",), "documents": ("doc_id",), "nation": ("n_nationkey",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, name: str) -> Records:
    return from_table(table(spark, sf_dir, name), name, *KEYS[name])


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def canonical(name: str, source: str, spec: dict, sql: str, part: str = "results") -> None:
    """Register a canonical query object over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(run_query(records(spark, sf_dir, source), spec), part)

    query(name, sql)(run)


_LINE = "'lineitem/' || l_orderkey || '/' || l_linenumber AS path"
_ORDER = "'orders/' || o_orderkey AS path"
_CUST = "'customer/' || c_custkey AS path"

canonical(
    "filter_compare", "lineitem",
    {"types": ["lineitem"], "where": "l_quantity > 45.0 && l_returnflag == 'R' && !(l_discount >= 0.05)", "select": ["l_orderkey", "l_quantity", "l_extendedprice"]},
    f"SELECT {_LINE}, l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND NOT l_discount >= 0.05",
)
canonical(
    "filter_in", "orders",
    {"where": "o_orderpriority in ['1-URGENT', '2-HIGH'] && o_orderstatus != 'O'", "select": ["o_orderkey", "o_orderpriority", "o_totalprice"]},
    f"SELECT {_ORDER}, o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'O'",
)
canonical(
    "filter_ternary", "orders",
    {"where": "(o_orderstatus == 'F' ? o_totalprice : 0.0 - o_totalprice) > 200000.0", "select": ["o_orderkey", "o_totalprice"]},
    f"SELECT {_ORDER}, o_orderkey, o_totalprice FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 - o_totalprice END) > 200000",
)
canonical(
    "filter_three_valued", "lineitem",
    {"where": "l_linenumber == 1 || 10 / (l_linenumber - 2) > 4", "select": ["l_orderkey", "l_linenumber"]},
    f"SELECT {_LINE}, l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR 10 // nullif(l_linenumber - 2, 0) > 4",
)
canonical(
    "projection_chain", "lineitem",
    {"projections": {"charge": {"expr": "projection.net * (1.0 + l_tax)"}, "net": {"expr": "l_extendedprice * (1.0 - l_discount)"}}, "where": "projection.charge > 90000.0", "select": ["l_orderkey", "projection.net", "projection.charge"]},
    f"SELECT {_LINE}, l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_extendedprice * (1 - l_discount) * (1 + l_tax) > 90000",
)
canonical(
    "select_expression", "part",
    {"select": ["p_partkey", {"name": "label", "expr": "p_brand + ':' + p_type.lower()"}, {"name": "large", "expr": "p_size > 25"}]},
    "SELECT 'part/' || p_partkey AS path, p_partkey, p_brand || ':' || lower(p_type) AS label, p_size > 25 AS large FROM part",
)
def ordered_whole(name: str, source: str, spec: dict, sql: str) -> None:
    """Register a canonical query over a whole table with every row's place in its order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return numbered(run_query(records(spark, sf_dir, source), spec).results)

    query(name, sql)(run)


def numbered(ordered: DataFrame) -> DataFrame:
    """The rows of an ordered result with their ``place``, from 1; partitions of a sorted table are counted, not gathered."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)).toDF(f"{fields}, place long")


ordered_whole(
    "order_nulls_desc_whole", "orders",
    {"projections": {"k": {"expr": "o_totalprice / (o_custkey % 3 == 0 ? 0.0 : 1.0)"}}, "select": ["o_orderkey", "projection.k"], "order_by": [{"field": "projection.k", "direction": "desc"}]},
    f"SELECT *, row_number() OVER (ORDER BY k DESC NULLS FIRST, path) AS place FROM (SELECT {_ORDER}, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS k FROM orders)",
)
ordered_whole(
    "order_multi_key_whole", "orders",
    {"select": ["o_orderstatus", "o_orderpriority"], "order_by": [{"field": "o_orderstatus", "direction": "desc"}, {"field": "o_orderpriority"}]},
    f"SELECT *, row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, o_orderpriority ASC NULLS LAST, path) AS place FROM (SELECT {_ORDER}, o_orderstatus, o_orderpriority FROM orders)",
)
canonical(
    "page_offset_limit", "customer",
    {"select": ["c_custkey", "c_acctbal"], "order_by": [{"field": "c_acctbal"}], "offset": 50, "limit": 25},
    f"SELECT {_CUST}, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, path LIMIT 25 OFFSET 50",
)
_FIVE = [{"name": f, "field": "l_linenumber", "function": f} for f in ("sum", "average", "minimum", "maximum", "filled", "empty")]
canonical(
    "group_summaries_all", "lineitem", {"group_by": ["l_returnflag"], "summaries": _FIVE},
    "SELECT l_returnflag, count(*) AS count, sum(l_linenumber)::BIGINT AS sum, avg(l_linenumber) AS average, min(l_linenumber) AS minimum, max(l_linenumber) AS maximum, count(l_linenumber) AS filled, count(*) - count(l_linenumber) AS empty FROM lineitem GROUP BY 1",
    "groups",
)
canonical(
    "group_two_keys", "orders",
    {"where": "o_totalprice > 1000.0", "group_by": [{"field": "o_orderstatus"}, {"field": "o_orderpriority", "direction": "desc"}], "summaries": [{"name": "top", "field": "o_totalprice", "function": "maximum"}]},
    "SELECT o_orderstatus, o_orderpriority, count(*) AS count, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2",
    "groups",
)
canonical(
    "summary_global", "lineitem", {"summaries": [{"name": "lines", "field": "l_linenumber", "function": "sum"}, {"name": "largest", "field": "l_extendedprice", "function": "maximum"}]},
    "SELECT count(*) AS count, sum(l_linenumber)::BIGINT AS lines, max(l_extendedprice) AS largest FROM lineitem",
    "groups",
)
canonical(
    "summary_custom_values", "orders",
    {"group_by": ["o_orderstatus"], "summary_functions": {"large": "values.filter(v, v > 150000.0).size()"}, "summaries": [{"name": "n_large", "field": "o_totalprice", "function": "large"}]},
    "SELECT o_orderstatus, count(*) AS count, count(*) FILTER (o_totalprice > 150000) AS n_large FROM orders GROUP BY 1",
    "groups",
)
canonical(
    "summary_empty_filled", "events",
    {"projections": {"note": {"expr": "event_type == 'error' ? '' : event_type"}}, "group_by": ["event_type"], "summaries": [{"name": "empty", "field": "projection.note", "function": "empty"}, {"name": "filled", "field": "projection.note", "function": "filled"}]},
    "SELECT event_type, count(*) AS count, count(*) FILTER (event_type = 'error') AS empty, count(*) FILTER (event_type <> 'error') AS filled FROM events GROUP BY 1",
    "groups",
)
canonical(
    "summary_earliest_latest", "orders",
    {"group_by": ["o_orderstatus"], "summaries": [{"name": "first", "field": "o_orderpriority", "function": "earliest"}, {"name": "last", "field": "o_orderdate", "function": "latest"}]},
    "SELECT o_orderstatus, count(*) AS count, min(o_orderpriority) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1",
    "groups",
)
canonical(
    "candidate_pushdown_residual", "lineitem",
    {"where": "l_quantity >= 49.0 && l_returnflag == 'A' && l_linestatus.lower() == 'f'", "select": ["l_orderkey", "l_partkey"]},
    f"SELECT {_LINE}, l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'A' AND lower(l_linestatus) = 'f'",
)


@query(
    "legacy_summaries",
    "SELECT count(DISTINCT o_orderpriority) AS o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, max(o_orderstatus) AS o_orderstatus FROM orders WHERE o_custkey <> 0",
)
def legacy_summaries(spark, sf_dir):
    spec = {"where": "o_custkey", "property_summaries": {"o_orderpriority": "Unique", "o_totalprice": "Average", "o_orderstatus": "Latest"}}
    out = run_plain_query(records(spark, sf_dir, "orders"), spec).summaries
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "legacy_unique_checked",
    "SELECT count(*) FILTER (o_totalprice > 100000) AS checked, count(*) FILTER (NOT o_totalprice > 100000) AS unchecked, count(DISTINCT o_orderstatus) AS statuses FROM orders",
)
def legacy_unique_checked(spark, sf_dir):
    from folioquery.operators.grouping import plain_summary

    r = records(spark, sf_dir, "orders")
    big = compiler("plain", Scope(dict(r.fields))).text("o_totalprice > 100000")
    return r.df.agg(plain_summary("Checked", big).alias("checked"), plain_summary("Unchecked", big).alias("unchecked"), plain_summary("Unique", r.fields["o_orderstatus"]).alias("statuses"))


@query(
    "legacy_filter_formula",
    f"SELECT {_ORDER}, o_orderkey, round(o_totalprice / 1000, 6) AS k FROM orders WHERE o_totalprice / 1000 > 300 OR (o_orderstatus = 'P' AND NOT starts_with(o_orderpriority, '1'))",
)
def legacy_filter_formula(spark, sf_dir):
    spec = {"formulas": {"k": "o_totalprice / 1000"}, "where": {"or": ["formula.k > 300", {"and": ["o_orderstatus == 'P'", {"not": "o_orderpriority.startsWith('1')"}]}]}}
    return run_plain_query(records(spark, sf_dir, "orders"), spec).results.select("path", "o_orderkey", F.round("k", 6).alias("k"))


@query(
    "legacy_group_rows",
    "SELECT p_size::VARCHAR AS value, count(*) AS count, list('part/' || p_partkey ORDER BY 'part/' || p_partkey) AS paths FROM part GROUP BY 1",
)
def legacy_group_rows(spark, sf_dir):
    return run_plain_query(records(spark, sf_dir, "part"), {"groupBy": {"property": "p_size", "direction": "DESC"}}).groups


@query(
    "enum_order_whole",
    f"SELECT *, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 6 END, path) AS place FROM (SELECT {_ORDER}, o_orderpriority FROM orders)",
)
def enum_order_whole(spark, sf_dir):
    r = run_plain_query(records(spark, sf_dir, "orders"), {"order_by": ["o_orderpriority"]}, enums={"o_orderpriority": ["5-LOW", "1-URGENT", "3-MEDIUM"]})
    return numbered(r.results.select("path", "o_orderpriority"))


@query(
    "keyset_page",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def keyset_page(spark, sf_dir):
    return paging.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], [200000.0, 7], 50)


@query(
    "read_many",
    "SELECT slot, o_orderkey, o_totalprice FROM (VALUES (0::BIGINT, 7), (1, 3), (2, -1), (3, 7)) t(slot, wanted) LEFT JOIN orders ON o_orderkey = wanted",
)
def read_many(spark, sf_dir):
    return paging.read_many(table(spark, sf_dir, "orders"), "o_orderkey", [7, 3, -1, 7]).select("slot", "o_orderkey", "o_totalprice")


@query(
    "match_type_rules",
    """SELECT 'part/' || p_partkey AS path, list_filter([CASE WHEN p_brand = 'Brand#11' OR p_brand = 'Brand#22' THEN 'brand' END, CASE WHEN p_size >= 25 AND p_retailprice > 1000 THEN 'large' END, CASE WHEN 'part/' || p_partkey LIKE 'part/1%' THEN 'ones' END], lambda x: x IS NOT NULL) AS types FROM part""",
)
def match_type_rules(spark, sf_dir):
    types = {
        "brand": TypeDef("brand", match={"match_expr": "p_brand == 'Brand#11' || p_brand == 'Brand#22'"}),
        "large": TypeDef("large", match={"where": {"p_size": {"gte": 25}}, "match_expr": "p_retailprice > 1000.0"}),
        "ones": TypeDef("ones", match={"path_glob": "part/1*"}),
    }
    r = classify(records(spark, sf_dir, "part"), types)
    return r.df.select(r.path.alias("path"), r.types.alias("types"))


def _event_records(spark, sf_dir) -> Records:
    r = records(spark, sf_dir, "events")
    return r.with_fields(props=Val(F.try_parse_json(F.col("props")), DYNAMIC))


@query(
    "defaults_coerce_computed",
    "SELECT event_id, (props->>'k')::BIGINT AS k, 'normal' AS level, (props->>'k')::BIGINT * 2 + 1 AS odd FROM events",
)
def defaults_coerce_computed(spark, sf_dir):
    r = _event_records(spark, sf_dir)
    r = r.with_fields(k=Val(F.try_variant_get(r.fields["props"].col, "$.k", "string"), r.fields["event_type"].kind))
    fields = {"k": Field("integer"), "level": Field("string", default="normal"), "odd": Field(computed="k * 2 + 1")}
    r = with_computed(with_coercion(with_defaults(r, fields), fields), fields)
    return r.df.select("event_id", *[r.fields[n].col.alias(n) for n in ("k", "level", "odd")])


@query(
    "json_member_presence",
    "SELECT 'events/' || event_id AS path, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z, (props->>'k')::DOUBLE AS k FROM events WHERE (props->>'k')::DOUBLE > 5",
)
def json_member_presence(spark, sf_dir):
    spec = {"where": "props.k > 5.0", "select": [{"name": "has_k", "expr": "has(props.k)"}, {"name": "has_z", "expr": "has(props.z)"}, {"name": "k", "expr": "props.k + 0.0"}]}
    return run_query(_event_records(spark, sf_dir), spec).results


def _columns(spark, sf_dir, source: str, dialect: str, exprs: dict[str, str], **scope) -> DataFrame:
    r = records(spark, sf_dir, source)
    c = compiler(dialect, Scope(dict(r.fields), r.bindings(), **scope))
    return r.df.select(r.path.alias("path"), *[c.text(x).col.alias(n) for n, x in exprs.items()])


@query(
    "string_library",
    f"""SELECT {_CUST}, upper(c_mktsegment) AS up, strlen(c_name) AS n_bytes, replace(c_name, '#', '-') AS replaced, string_split(c_name, '#')[2] AS number,
    substr(c_name, 1, 4) AS head, right(c_name, 3) AS tail, starts_with(c_mktsegment, 'A') AS starts, regexp_matches(c_name, '0+1') AS hit, repeat(left(c_mktsegment, 1), 3) AS thrice FROM customer""",
)
def string_library(spark, sf_dir):
    return _columns(spark, sf_dir, "customer", "plain", {
        "up": "c_mktsegment.upper()", "n_bytes": "c_name.length()", "replaced": "c_name.replace('#', '-')", "number": "c_name.split('#')[1]",
        "head": "c_name.slice(0, 4)", "tail": "c_name.slice(-3)", "starts": "c_mktsegment.startsWith('A')", "hit": "c_name.matches('0+1')", "thrice": "c_mktsegment[0].repeat(3)",
    })


@query(
    "math_library",
    "SELECT 'part/' || p_partkey AS path, abs(p_size - 25)::BIGINT AS away, floor(p_retailprice)::BIGINT AS low, ceil(p_retailprice)::BIGINT AS high, round(p_retailprice)::BIGINT AS near, p_size % 7 AS rest, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio, least(p_size, 10) AS small, -p_size AS minus FROM part",
)
def math_library(spark, sf_dir):
    out = _columns(spark, sf_dir, "part", "plain", {
        "away": "abs(p_size - 25)", "low": "floor(p_retailprice)", "high": "ceil(p_retailprice)", "near": "round(p_retailprice)", "rest": "p_size % 7",
        "ratio": "p_retailprice / (p_size % 5)", "small": "min(p_size, 10)", "minus": "-p_size",
    })
    return out.select("path", F.col("away").cast("long").alias("away"), "low", "high", "near", F.col("rest").cast("int").alias("rest"), F.round("ratio", 6).alias("ratio"), F.col("small").cast("int").alias("small"), "minus")


@query(
    "date_library",
    f"""SELECT {_ORDER}, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS weekday, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS later,
    (o_orderdate::DATE + 10)::DATE AS soon, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS until FROM orders""",
)
def date_library(spark, sf_dir):
    return _columns(spark, sf_dir, "orders", "cel", {
        "y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "weekday": "dayOfWeek(o_orderdate)", "later": "addMonths(date(o_orderdate), 1)",
        "soon": "addDays(date(o_orderdate), 10)", "until": "daysUntil(o_orderdate, date('2000-01-01'))",
    })


@query(
    "array_library",
    "SELECT 'part/' || p_partkey AS path, len(string_split(p_type, ' ')) AS n, string_split(p_type, ' ')[-1] AS final, array_to_string(list_reverse(string_split(p_type, ' ')), '-') AS reversed, list_filter(string_split(p_type, ' '), lambda x: length(x) > 5) AS long_words, list_contains(string_split(p_type, ' '), 'STEEL') AS steel FROM part",
)
def array_library(spark, sf_dir):
    return _columns(spark, sf_dir, "part", "plain", {
        "n": "p_type.split(' ').length()", "final": "p_type.split(' ').last()", "reversed": "p_type.split(' ').reverse().join('-')",
        "long_words": "p_type.split(' ').filter(value.length() > 5)", "steel": "p_type.split(' ').contains('STEEL')",
    })


@query(
    "duration_arithmetic",
    f"SELECT {_ORDER}, (o_orderdate + INTERVAL 2 DAY + INTERVAL 3 HOUR)::TIMESTAMP AS due, date_diff('millisecond', TIMESTAMP '1990-01-01 00:00:00', o_orderdate) AS age_ms FROM orders WHERE o_orderdate - INTERVAL 1 MONTH > TIMESTAMP '1995-01-01 00:00:00'",
)
def duration_arithmetic(spark, sf_dir):
    r = records(spark, sf_dir, "orders")
    c = compiler("plain", Scope(dict(r.fields), r.bindings()))
    kept = r.df.where(c.truth(c.text("o_orderdate - '1 month' > datetime('1995-01-01T00:00:00')")))
    return kept.select(r.path.alias("path"), c.text("o_orderdate + '51h'").col.alias("due"), c.text("o_orderdate - datetime('1990-01-01')").col.alias("age_ms"))


@query(
    "link_traverse_one_hop",
    "SELECT l_orderkey, l_linenumber, o_orderstatus AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000",
)
def link_traverse_one_hop(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    hop = links.traverse(table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey", "order_")
    return hop.where("order_o_totalprice > 300000").select("l_orderkey", "l_linenumber", F.col("order_o_orderstatus").alias("status"))


@query(
    "link_traverse_two_hop",
    "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
def link_traverse_two_hop(spark, sf_dir):
    one = links.traverse(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "cust_")
    two = links.traverse(one, "cust_c_nationkey", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "nation_")
    return two.groupBy(F.col("nation_n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _buyers(spark, sf_dir) -> tuple[Records, Records]:
    """Orders that link to their customer, and customers and nations, of which customers link to their nation."""
    orders, customer, nation = (records(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    link = lambda t, c: F.concat(F.lit(f"/{t}/"), F.col(c).cast("string"))
    orders = orders.with_fields(buyer=Val(link("customer", "o_custkey"), STRING))
    paths = [r.df.select("*", r.path.alias("path"), r.types.alias("types")) for r in (customer, nation)]
    both = paths[0].withColumn("home", link("nation", "c_nationkey")).unionByName(paths[1], allowMissingColumns=True)
    fields = {f.name: Val(F.col(f.name), kind_of(f.dataType)) for f in both.schema.fields if f.name not in ("path", "types")}
    return orders, Records(both, F.col("path"), fields, fields, F.col("types"), path_facts(F.col("path")))


@query(
    "as_file_one_hop",
    f"SELECT {_ORDER}, 'customer/' || c_custkey AS target, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000",
)
def as_file_one_hop(spark, sf_dir):
    orders, targets = _buyers(spark, sf_dir)
    spec = {"where": "buyer.asFile().c_acctbal > 5000.0", "select": [{"name": "target", "expr": "buyer.asFile().file.path"}, {"name": "segment", "expr": "buyer.asFile().c_mktsegment"}]}
    return run_query(orders, spec, targets=targets).results


@query(
    "as_file_two_hops_typed",
    f"SELECT {_ORDER}, n_name AS nation, NULL::VARCHAR AS wrong, o_custkey % 2 = 0 AS odd_link FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey",
)
def as_file_two_hops_typed(spark, sf_dir):
    """Two hops; a hop whose target has another type; a link made in the expression that leads nowhere half of the time."""
    orders, targets = _buyers(spark, sf_dir)
    spec = {"select": [
        {"name": "nation", "expr": "buyer.asFile().home.asFile({'types': ['nation']}).n_name"},
        {"name": "wrong", "expr": "buyer.asFile({'types': ['nation']}).c_name"},
        {"name": "odd_link", "expr": "(o_custkey % 2 == 0 ? buyer : '[[nobody]]').asFile() != null"},
    ]}
    return run_query(orders, spec, targets=targets).results


@query(
    "backlinks",
    "SELECT 'customer/' || o_custkey AS target_path, list('orders/' || o_orderkey ORDER BY 'orders/' || o_orderkey) AS sources, count(*) AS n_sources FROM orders GROUP BY 1",
)
def backlinks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = lambda t, c: F.concat(F.lit(f"{t}/"), F.col(c).cast("string"))
    return links.backlinks(o.select(path("orders", "o_orderkey").alias("source_path"), path("customer", "o_custkey").alias("target_path")))


@query("broken_links_anti", "SELECT o_orderkey, o_custkey + 7 AS target FROM orders WHERE o_custkey + 7 NOT IN (SELECT c_custkey FROM customer)")
def broken_links_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 7).alias("target"))
    return links.broken(o, F.col("target"), table(spark, sf_dir, "customer"), "c_custkey")


def _named_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    folder = F.concat(F.lit("b"), (F.col("p_partkey") % 7).cast("string"))
    path = F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_name"), F.lit(".md"))
    return part.select(path.alias("path"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"))


_EVERY = """
    WITH t AS (SELECT 'b' || p_partkey % 7 || '/' || p_partkey || '/' || p_name || '.md' AS path, 'b' || p_partkey % 7 || '/' || p_partkey AS folder, lower(p_name) AS k FROM part),
    names AS (SELECT p_name FROM part GROUP BY 1 UNION ALL SELECT 'absent ' || p_name FROM part GROUP BY p_name),
    s AS (SELECT 'b' || s_suppkey % 7 || '/supplier' || s_suppkey || '.md' AS source_path, 'b' || s_suppkey % 7 AS folder, p_name, '[[' || p_name || ']]' AS raw_target FROM supplier, names)"""


def _every_name(spark, sf_dir):
    """Every supplier names every part, and as many names that no part has."""
    name = table(spark, sf_dir, "part").select("p_name").distinct()
    name = name.unionByName(name.select(F.concat(F.lit("absent "), "p_name").alias("p_name")))
    source = F.concat(F.lit("b"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/supplier"), F.col("s_suppkey").cast("string"), F.lit(".md"))
    asked = table(spark, sf_dir, "supplier").crossJoin(name)
    return asked.select(source.alias("source_path"), F.concat(F.lit("[["), F.col("p_name"), F.lit("]]")).alias("raw_target")), _named_parts(spark, sf_dir)


@query(
    "resolve_ranked_every_name",
    _EVERY + " SELECT source_path, raw_target, path AS target_path, CASE WHEN path IS NULL THEN 'missing' END AS reason FROM (SELECT s.*, t.path, row_number() OVER (PARTITION BY source_path, raw_target ORDER BY t.folder <> s.folder, len(string_split(t.path, '/')), t.path) AS n FROM s LEFT JOIN t ON t.k = lower(s.p_name)) WHERE n = 1",
)
def resolve_ranked_every_name(spark, sf_dir):
    return links.resolve(*_every_name(spark, sf_dir))


@query(
    "resolve_unique_every_name",
    _EVERY + " SELECT source_path, raw_target, CASE WHEN count(t.path) = 1 THEN min(t.path) END AS target_path, CASE WHEN count(t.path) > 1 THEN 'ambiguous' WHEN count(t.path) = 0 THEN 'missing' END AS reason FROM s LEFT JOIN t ON t.k = lower(s.p_name) GROUP BY 1, 2",
)
def resolve_unique_every_name(spark, sf_dir):
    return links.resolve(*_every_name(spark, sf_dir), unique=True)


@query(
    "uniqueness_conflicts",
    "WITH s AS (SELECT text AS value FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT 'documents/' || doc_id AS path, md5(text) AS value FROM documents JOIN s ON text = value UNION ALL "
    "SELECT 'customer/' || c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1)",
)
def uniqueness_conflicts(spark, sf_dir):
    d = records(spark, sf_dir, "documents")
    d = d.with_fields(digest=Val(F.md5(F.col("text").cast("binary")), d.fields["text"].kind))
    texts = quality.uniqueness_conflicts(d, "digest").select("path", "value")
    return texts.unionByName(quality.uniqueness_conflicts(records(spark, sf_dir, "customer"), "c_mktsegment").select("path", "value"))


@query(
    "snapshot_diff_events",
    """WITH a AS (SELECT 'o/' || o_orderkey AS k, md5(o_orderkey || o_orderstatus) AS r FROM orders WHERE o_orderkey % 10 <> 0),
    b AS (SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'moved/' ELSE 'o/' END || o_orderkey AS k, CASE WHEN o_orderkey % 10 = 5 THEN md5('x' || o_orderkey) ELSE md5(o_orderkey || o_orderstatus) END AS r FROM orders WHERE o_orderkey % 10 <> 1),
    j AS (SELECT coalesce(a.k, b.k) AS k, a.r AS ra, b.r AS rb, a.k IS NULL AS c, b.k IS NULL AS d FROM a FULL JOIN b ON a.k = b.k),
    x AS (SELECT d.k AS f, c.k AS t, d.ra FROM j d JOIN j c ON d.d AND c.c AND d.ra = c.rb)
    SELECT 'renamed' AS event_type, t AS path, f AS previous_path FROM x UNION ALL
    SELECT CASE WHEN c THEN 'created' WHEN d THEN 'deleted' ELSE 'modified' END, k, NULL FROM j WHERE (c OR d OR ra <> rb) AND k NOT IN (SELECT f FROM x) AND k NOT IN (SELECT t FROM x)""",
)
def snapshot_diff_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, rest = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 10
    rev = F.md5(F.concat(key, "o_orderstatus").cast("binary"))
    old = o.where(rest != 0).select(F.concat(F.lit("o/"), key).alias("path"), rev.alias("revision"))
    moved = F.concat(F.when(rest == 3, "moved/").otherwise("o/"), key)
    new = o.where(rest != 1).select(moved.alias("path"), F.when(rest == 5, F.md5(F.concat(F.lit("x"), key).cast("binary"))).otherwise(rev).alias("revision"))
    return diff.snapshot_diff(old, new).select("event_type", "path", "previous_path")


@query(
    "view_merge_whole",
    "SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, path) AS place FROM (SELECT 'part/' || p_partkey AS path, p_partkey, p_retailprice, p_retailprice * 2 AS twice FROM part WHERE p_size > 10 AND p_retailprice * 2 < 2400)",
)
def view_merge_whole(spark, sf_dir):
    doc = {"query": {"where": "p_size > 10", "projections": {"twice": {"expr": "p_retailprice * 2.0"}}, "order_by": [{"field": "p_retailprice", "direction": "desc"}]}, "views": [{"name": "cheap", "query": {"where": "projection.twice < 2400.0", "select": ["p_partkey", "p_retailprice", "projection.twice"]}}]}
    return numbered(run_saved(records(spark, sf_dir, "part"), doc, "cheap").results)


_VIEW = """
filters: {and: ['p_size > 5']}
formulas: {urgency: 'p_size * 10 + p_partkey'}
views:
  - name: main
    filters: {or: ['p_brand == "Brand#11"', 'formula.urgency > 400']}
    order: [p_partkey, formula.urgency]
    sort: [{property: formula.urgency, direction: DESC}]
    groupBy: {property: p_brand, direction: ASC}
"""


@query(
    "view_formula_sort",
    "SELECT 'part/' || p_partkey AS path, p_partkey, (p_size * 10 + p_partkey)::DOUBLE AS urgency FROM part WHERE p_size > 5 AND (p_brand = 'Brand#11' OR p_size * 10 + p_partkey > 400)",
)
def view_formula_sort(spark, sf_dir):
    return run_view(records(spark, sf_dir, "part"), _VIEW, "main").results


@query(
    "view_formula_group",
    "SELECT '\"' || p_brand || '\"' AS value, count(*) AS count FROM part WHERE p_size > 5 AND (p_brand = 'Brand#11' OR p_size * 10 + p_partkey > 400) GROUP BY 1",
)
def view_formula_group(spark, sf_dir):
    return run_view(records(spark, sf_dir, "part"), _VIEW, "main").groups


@query(
    "event_admission_dedupe",
    "SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM events",
)
def event_admission_dedupe(spark, sf_dir):
    return ev.admit(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "outcome")


@query(
    "debounce_last_wins",
    "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n >= ts + INTERVAL 6 HOUR",
)
def debounce_last_wins(spark, sf_dir):
    return ev.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600).select("event_id", "user_id")


@query(
    "throttle_first_wins",
    """WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL
    SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 24 HOUR) FROM r WHERE r.ts IS NOT NULL)
    SELECT e.event_id, e.user_id FROM r JOIN events e ON e.user_id = r.user_id AND e.ts = r.ts""",
)
def throttle_first_wins(spark, sf_dir):
    return ev.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 24 * 3600).select("event_id", "user_id")


@query(
    "event_windows",
    "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_windows(spark, sf_dir):
    out = ev.windowed(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "validate_constraints",
    """SELECT 'customer/' || c_custkey AS path, 'c_acctbal' AS field, 'below_minimum' AS code, 'error' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL
    SELECT 'customer/' || c_custkey, 'c_mktsegment', 'not_in_enum', 'error' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL
    SELECT 'customer/' || c_custkey, 'c_name', 'pattern_mismatch', 'error' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')""",
)
def validate_constraints(spark, sf_dir):
    fields = {"c_acctbal": Field("number", min=0), "c_mktsegment": Field("enum", values=("BUILDING", "MACHINERY")), "c_name": Field("string", pattern="[02468]$", required=True)}
    return quality.validate(records(spark, sf_dir, "customer"), fields)


@query(
    "generate_sequence",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (SELECT max(p_partkey) FILTER (p_partkey % 3 <> 0) FROM part) + row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY p_partkey) ELSE p_partkey END AS number FROM part",
)
def generate_sequence(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("number"))
    return quality.generate_sequence(part, "number", [F.col("p_partkey")])


@query("backfill_defaults", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status FROM orders")
def backfill_defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return quality.backfill(o, {"status": F.lit("none")})


@query(
    "batch_apply",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 5 <> 2 UNION ALL SELECT 100 + n_nationkey, 'new' FROM nation WHERE n_nationkey % 5 = 3",
)
def batch_apply(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rest = F.col("n_nationkey") % 5
    changes = n.where(rest.isin(1, 2)).select(F.when(rest == 1, "update").otherwise("delete").alias("op"), "n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    made = n.where(rest == 3).select(F.lit("create").alias("op"), (F.col("n_nationkey") + 100).alias("n_nationkey"), F.lit("new").alias("n_name"))
    return quality.apply_batch(n, "n_nationkey", changes.unionByName(made))[0]


#: A link's target in raw markup: in double or single quotes, or bare.
_HREF = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


@query(
    "page_links_extract",
    "SELECT page_id, url, unnest(list_distinct(list_transform(regexp_extract_all(html, '" + _HREF.replace("'", "''") + "', 1), lambda x: regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')))) AS target FROM pages",
)
def page_links_extract(spark, sf_dir):
    """Links of the raw pages, distinct by page, as edges."""
    pages = table(spark, sf_dir, "pages")
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return pages.select("page_id", "url", F.explode(F.array_distinct(hrefs)).alias("target"))


@query(
    "tags_extract",
    "SELECT p_partkey, [replace(p_type, ' ', '/')] AS tags, ['[[' || p_name || '|it]]', 'x/' || p_brand || '.md'] AS links FROM part",
)
def tags_extract(spark, sf_dir):
    """Tags and links of bodies: link text is made from columns, since the given texts have none."""
    part = table(spark, sf_dir, "part")
    body = F.concat(F.lit("see [["), "p_name", F.lit("|it]] and [b](x/"), "p_brand", F.lit(".md) #"), F.regexp_replace("p_type", " ", "/"), F.lit(" `#no` #fff"))
    return part.select("p_partkey", links.body_tags(body).alias("tags"), F.transform(links.body_links(body), lambda x: x["raw_target"]).alias("links"))


@query(
    "string_library_more",
    f"""SELECT {_CUST}, c_name AS trimmed, c_name AS left_trimmed, c_name AS right_trimmed, contains(c_name, 'Cust') AND contains(c_name, '1') AS has_all, contains(c_mktsegment, 'BUILD') OR contains(c_mktsegment, 'MACH') AS has_any,
    ends_with(c_name, '7') AS ends, reverse(c_name) AS backwards, lower(replace(c_name, '#', '-')) AS slug, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS titled FROM customer""",
)
def string_library_more(spark, sf_dir):
    return _columns(spark, sf_dir, "customer", "plain", {
        "trimmed": "('  ' + c_name + ' ').trim()", "left_trimmed": "('  ' + c_name).trimStart()", "right_trimmed": "(c_name + '  ').trimEnd()", "has_all": "c_name.containsAll('Cust', '1')",
        "has_any": "c_mktsegment.containsAny('BUILD', 'MACH')", "ends": "c_name.endsWith('7')", "backwards": "c_name.reverse()", "slug": "c_name.slugify()", "titled": "c_mktsegment.lower().title()",
    })


@query(
    "view_text_library",
    f"SELECT {_CUST}, '&lt;' || c_name || '&gt;' AS escaped, c_custkey::VARCHAR AS fixed, replace(c_name, '0', 'o') AS every, contains(lower(c_mktsegment), 'build') AS hit FROM customer",
)
def view_text_library(spark, sf_dir):
    return _columns(spark, sf_dir, "customer", "view", {"escaped": "('<' + c_name + '>').escapeHTML()", "fixed": "c_custkey.toFixed(0)", "every": "c_name.replace(/0/g, 'o')", "hit": "/build/i.matches(c_mktsegment)"})


@query(
    "list_library_more",
    """WITH t AS (SELECT 'part/' || p_partkey AS path, string_split(p_type, ' ') AS w FROM part)
    SELECT path, list_sort(w) AS sorted, list_sort(list_distinct(w)) AS once, w[2:2] AS middle, w[1] AS head, list_transform(w, lambda x: lower(x)) AS lowered, list_sum(list_transform(w, lambda x: strlen(x)))::DOUBLE AS letters FROM t""",
)
def list_library_more(spark, sf_dir):
    words = "p_type.split(' ')"
    return _columns(spark, sf_dir, "part", "plain", {
        "sorted": f"{words}.sort()", "once": "(p_type + ' ' + p_type).split(' ').unique().sort()", "middle": f"{words}.slice(1, 2)", "head": f"{words}.first()",
        "lowered": f"{words}.map(value.lower())", "letters": f"{words}.map(value.length()).reduce(acc + value, 0)",
    })


@query(
    "list_macros",
    "SELECT 'part/' || p_partkey AS path, p_size > 5 AS every, p_size > 40 AS some, p_size <= 15 AS one, [p_size * 2, 6]::BIGINT[] AS doubled, (p_size + 3)::DOUBLE AS total, (p_size + 3) / 2 AS mean FROM part",
)
def list_macros(spark, sf_dir):
    return _columns(spark, sf_dir, "part", "cel", {
        "every": "[p_size, 10, 20].all(x, x > 5)", "some": "[p_size, 3].exists(x, x > 40)", "one": "[p_size, 10, 20].exists_one(x, x > 15)", "doubled": "[p_size, 3].map(x, x * 2)",
        "total": "[p_size, 3].sum()", "mean": "[p_size, 3].mean()",
    })


@query(
    "date_parts",
    "SELECT 'events/' || event_id AS path, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, date_trunc('day', ts)::TIMESTAMP AS start, (ts::DATE + INTERVAL 1 YEAR)::DATE AS next_year FROM events",
)
def date_parts(spark, sf_dir):
    out = _columns(spark, sf_dir, "events", "cel", {"h": "hour(ts)", "m": "minute(ts)", "s": "second(ts)", "start": "startOfDay(ts)", "next_year": "addYears(date(ts), 1)"})
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("date_texts", "SELECT 'events/' || event_id AS path, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y/%m/%d %H:%M') AS shown FROM events")
def date_texts(spark, sf_dir):
    return _columns(spark, sf_dir, "events", "plain", {"clock": "time(ts)", "shown": "ts.format('YYYY/MM/DD HH:mm')"})


@query(
    "legacy_text_addition",
    f"""SELECT {_ORDER}, strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate::DATE - 10, '%Y-%m-%d') AS sooner, NULL::VARCHAR AS wrong,
    o_orderpriority || o_custkey AS joined, 2592000.0::DOUBLE AS month FROM orders""",
)
def legacy_text_addition(spark, sf_dir):
    """Dates written as text move by durations; a date and another text is an error, null here."""
    r = records(spark, sf_dir, "orders")
    r = r.with_fields(due=Val(F.date_format("o_orderdate", "yyyy-MM-dd"), STRING))
    c = compiler("plain", Scope(dict(r.fields), r.bindings()))
    exprs = {"later": "due + '1 month'", "sooner": "due - '10 days'", "wrong": "due + o_orderpriority", "joined": "o_orderpriority + o_custkey", "month": "duration('1 month') / 1000"}
    return r.df.select(r.path.alias("path"), *[c.text(x).col.alias(n) for n, x in exprs.items()])


@query(
    "match_operators",
    f"""SELECT {_CUST}, list_filter([CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 5000 THEN 'a' END, CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal > 0 THEN 'b' END,
    CASE WHEN contains(c_name, '9') AND c_acctbal <= 9000 THEN 'c' END, CASE WHEN starts_with(c_mktsegment, 'M') OR false THEN 'd' END, CASE WHEN regexp_matches(c_name, '[13]$') THEN 'e' END, 'f'], lambda x: x IS NOT NULL) AS types FROM customer""",
)
def match_operators(spark, sf_dir):
    where = {
        "a": {"c_mktsegment": "BUILDING", "c_acctbal": {"lt": 5000}}, "b": {"c_mktsegment": {"neq": "BUILDING"}, "c_acctbal": {"gt": 0}}, "c": {"c_name": {"contains": "9"}, "c_acctbal": {"lte": 9000}},
        "d": {"c_mktsegment": {"startsWith": "M"}}, "e": {"c_name": {"matches": "[13]$"}}, "g": {"nothing": {"exists": True}},
    }
    types = {k: TypeDef(k, match={"where": w}) for k, w in where.items()}
    types["f"] = TypeDef("f", match={"fields_present": ["c_name", "c_custkey"]})
    r = classify(records(spark, sf_dir, "customer"), types)
    return r.df.select(r.path.alias("path"), r.types.alias("types"))


@query("legacy_folder_default_order", f"SELECT *, row_number() OVER (ORDER BY path) AS place FROM (SELECT {_ORDER}, o_custkey FROM orders)")
def legacy_folder_default_order(spark, sf_dir):
    return numbered(run_plain_query(records(spark, sf_dir, "orders"), {"folder": "orders"}).results.select("path", "o_custkey"))


@query(
    "contract_projection",
    "SELECT 'customer/' || c_custkey AS path, c_custkey AS id, c_name AS label, c_acctbal AS balance FROM customer",
)
def contract_projection(spark, sf_dir):
    from folioquery.operators.types import contract

    r = records(spark, sf_dir, "customer")
    return r.df.select(r.path.alias("path"), *[v.col.alias(k) for k, v in contract(r, {"id": "c_custkey", "label": "c_name", "balance": "c_acctbal"}).items()])


@query(
    "candidate_dynamic_prefilter",
    "SELECT event_id FROM events WHERE event_type = 'error' AND (props->>'k')::DOUBLE >= 40",
)
def candidate_dynamic_prefilter(spark, sf_dir):
    from folioquery.plans.candidates import candidate

    r = _event_records(spark, sf_dir)
    where = "event_type == 'error' && props.k >= 40.0"
    early = candidate(r, where)
    return run_query(replace(r, df=r.df.where(early)), {"where": where, "select": ["event_id"]}).results.select("event_id")


@query(
    "file_functions",
    "SELECT 'part/' || p_partkey AS path, p_partkey % 3 = 0 AS low, true AS inside, false AS root FROM part",
)
def file_functions(spark, sf_dir):
    r = records(spark, sf_dir, "part")
    rest = F.col("p_partkey") % 3
    tags = Val(F.array(F.when(rest == 0, "size/low").otherwise("size"), F.lit("part")), list_of(r.fields["p_name"].kind))
    r = replace(r, file={**r.file, "tags": tags})
    return run_query(r, {"where": "file.hasTag('part')", "select": [{"name": "low", "expr": "file.hasTag('size/low')"}, {"name": "inside", "expr": "file.inFolder('part')"}, {"name": "root", "expr": "file.inFolder('')"}]}).results


@query(
    "follow_list_links",
    "SELECT c_nationkey, list(o.status ORDER BY o.at) AS statuses FROM (SELECT c_nationkey, unnest([c_nationkey * 10, c_nationkey * 10 + 3, -1]) AS k, unnest([0, 1, 2]) AS at FROM (SELECT DISTINCT c_nationkey FROM customer)) l LEFT JOIN LATERAL (SELECT l.at AS at, (SELECT o_orderstatus FROM orders WHERE o_orderkey = l.k) AS status) o ON true GROUP BY 1",
)
def follow_list_links(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    k = F.col("c_nationkey").cast("long") * 10
    owners = owners.withColumn("links", F.array(k, k + 3, F.lit(-1).cast("long")))
    return links.follow_each(owners, "c_nationkey", "links", table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "statuses").select("c_nationkey", "statuses")


@query(
    "cache_staleness",
    "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM (SELECT o_orderkey AS path, o_totalprice AS m FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS path, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS m FROM orders WHERE o_orderkey % 11 <> 0) b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m",
)
def cache_staleness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    now = o.where(key % 7 != 0).select(key.alias("path"), price.alias("mtime"))
    then = o.where(key % 11 != 0).select(key.alias("path"), (price + F.when(key % 5 == 0, 1).otherwise(0)).alias("mtime"))
    return diff.stale(now, then)


@query(
    "concurrency_replace",
    "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'run' ELSE 'cancelled' END AS outcome FROM events",
)
def concurrency_replace(spark, sf_dir):
    return ev.concurrency(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "replace").select("event_id", "outcome")


@query("ordered_feed", "SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS watermark FROM events")
def ordered_feed(spark, sf_dir):
    return ev.ordered_feed(table(spark, sf_dir, "events").select("event_id", "ts"), 1000, [F.col("ts"), F.col("event_id")]).select("event_id", "watermark")


@query(
    "lifecycle_actions",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') END AS slug, CASE WHEN s_acctbal > 0 THEN s_name END AS shown FROM supplier",
)
def lifecycle_actions(spark, sf_dir):
    from folioquery.operators.lifecycle import Action, run_actions

    r = run_actions(records(spark, sf_dir, "supplier"), [Action({"slug": {"slugify": "s_name"}, "shown": {"copy": "s_name"}}, "s_acctbal > 0.0")], now="2024-01-01T00:00:00Z")
    return r.df.select("s_suppkey", r.fields["slug"].col.alias("slug"), r.fields["shown"].col.alias("shown"))


@query(
    "rename_references",
    "SELECT 'orders/' || o_orderkey AS source_path, '[[customer/' || o_custkey || '|buyer]]' AS raw_target, 'client/' || o_custkey || '.md' AS new_path, '[[client/' || o_custkey || '|buyer]]' AS new_target FROM orders WHERE o_custkey % 10 = 0",
)
def rename_references(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("source_path"), F.concat(F.lit("[[customer/"), cust, F.lit("|buyer]]")).alias("raw_target"), F.concat(F.lit("customer/"), cust, F.lit(".md")).alias("target_path"))
    c = F.col("c_custkey").cast("string")
    renames = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("customer/"), c, F.lit(".md")).alias("old_path"), F.concat(F.lit("client/"), c, F.lit(".md")).alias("new_path"))
    return links.rename_references(edges, renames)
