"""Links followed in expressions: relative and named links, ambiguity, missing targets, repeated paths."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators import links
from folioquery.operators.frame import Records, path_facts
from folioquery.operators.links import traverse
from folioquery.plans import hops
from folioquery.plans.compiler import Val
from folioquery.plans.query import run_query
from folioquery.plans.syntax import ExpressionError
from folioquery.values import kind_of

ROWS = [
    ("notes/1.md", None, None, "[[alpha]]", "note"), ("notes/2.md", None, None, "[[twice]]", "note"), ("notes/3.md", None, None, None, "note"),
    ("notes/4.md", None, None, "../sources/a.md", "note"), ("notes/5.md", None, None, "/d/x.md", "note"), ("notes/6.md", None, None, "", "note"),
    ("sources/a.md", "alpha", "Alpha", "b", "source"), ("sources/b.md", "twice", "Beta", None, "source"), ("sources/c.md", "twice", "Gamma", None, "source"),
    ("d/x.md", None, "X", None, "other"), ("d/x.md", None, "Y", None, "other"),
]


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame(ROWS, "path string, id string, title string, link string, kind string")
    df = df.withColumns({"types": F.array("kind"), "xs": F.array("link"), "reason": F.lit("own"), "target_path": F.lit("own")})
    fields = {f.name: Val(F.col(f.name), kind_of(f.dataType)) for f in df.schema.fields if f.name not in ("path", "types")}
    return Records(df, F.col("path"), fields, fields, F.col("types"), path_facts(F.col("path")))


def test_hops_lead_to_one_record_or_none(notes):
    hop = "link.asFile()"
    exprs = {"to": f"{hop}.file.path", "title": f"{hop}.title", "next": f"{hop}.link.asFile().title", "typed": "link.asFile({'types': ['other']}).title", "alone": "link.asFile({'ambiguity': 'unique'}).title", "none": "'[[nobody]]'.asFile() == null"}
    out = run_query(notes, {"types": ["note"], "select": [{"name": k, "expr": e} for k, e in exprs.items()] + ["reason"]})
    rows = [tuple(r) for r in out.results.collect()]
    led = ("sources/a.md", "Alpha", "Beta")
    assert [r[1:4] for r in rows] == [led, (None,) * 3, (None,) * 3, led, (None,) * 3, (None,) * 3]
    assert [r[5] for r in rows] == ["Alpha", None, None, "Alpha", None, None]
    assert all(r[4] is None and r[6] is True and r[7] == "own" for r in rows)
    assert [(r.path, r.message, r.field) for r in out.diagnostics.collect()] == [("notes/2.md", "ambiguous link", "select.alone")]


def test_a_filter_and_a_projection_follow_links(notes):
    spec = {"projections": {"of": {"expr": "link.asFile().title"}}, "where": "projection.of == 'Alpha' && link.asFile().id == 'alpha'", "select": ["projection.of"]}
    out = run_query(notes, spec)
    assert [tuple(r) for r in out.results.collect()] == [("notes/1.md", "Alpha"), ("notes/4.md", "Alpha")]
    assert out.total_count() == 2


def test_hops_over_no_records(notes):
    from dataclasses import replace

    empty = replace(notes, df=notes.df.where("false"))
    spec = {"types": ["note"], "select": [{"name": "to", "expr": "link.asFile().title"}]}
    assert run_query(empty, spec).results.count() == 0
    assert [r.to for r in run_query(notes, spec, targets=empty).results.collect()] == [None] * 6


@pytest.mark.parametrize("expr", ["xs.map(x, x.asFile().title)", "link.asFile({'depth': 1})", "link.asFile({'types': []})", "link.asFile('a', {}, 1)"])
def test_refused(notes, expr):
    with pytest.raises(ExpressionError):
        run_query(notes, {"select": [{"name": "x", "expr": expr}]})


def test_traverse_keeps_every_row_once(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id long, link long")
    targets = spark.createDataFrame([(10, "a"), (20, "b"), (20, "c")], "key long, name string")
    out = traverse(left, "link", targets, "key", "t_")
    assert sorted((r.id, r.t_key, r.t_name) for r in out.collect()) == [(1, 10, "a"), (2, None, None), (3, None, None), (4, None, None)]


@pytest.fixture
def many(notes):
    """Records of one folder: an eighth has no link, an eighth a name of its own that none has, three eighths one such name, the others lead to a few records."""
    from dataclasses import replace

    n = F.col("n")
    link = F.when(n % 8 == 0, None).when(n % 8 == 1, F.concat(F.lit("no "), n)).when(n % 2 == 1, "[[nobody]]").when(n % 4 == 2, "/sources/a.md").otherwise("[[twice]]")
    df = notes.df.sparkSession.range(8000).withColumnRenamed("id", "n").select(F.concat(F.lit("many/"), n).alias("path"), link.alias("link"), F.array(F.lit("note")).alias("types"))
    fields = {"link": Val(F.col("link"), kind_of(df.schema["link"].dataType))}
    return replace(notes, df=df, fields=fields, raw=fields)


def test_links_of_a_folder_are_resolved_once(many, notes, monkeypatch):
    asked = []
    for name in ("pick", "resolve"):
        if hasattr(hops, name):
            monkeypatch.setattr(hops, name, lambda df, *a, f=getattr(hops, name), **k: (asked.append(df), f(df, *a, **k))[1])
    out = run_query(many, {"select": [{"name": "to", "expr": "link.asFile().title"}]}, targets=notes)
    assert {(r.to, r["count"]) for r in out.results.groupBy("to").count().collect()} == {("Alpha", 2000), (None, 6000)}
    assert asked[0].count() == 1000 + 3


def test_names_join_no_table_on_a_null(spark):
    """Links by path have no name; a join by it would deal all of them to one task."""
    asked = spark.createDataFrame([("a/x.md", "/b/y.md")], "source_path string, raw_target string")
    records = spark.createDataFrame([("b/y.md", None, None)], "path string, id string, title string")
    found = links.resolve(asked, records)
    assert [r.target_path for r in found.collect()] == ["b/y.md"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


@pytest.mark.parametrize("ambiguity", ["native", "unique"])
def test_popular_and_missing_links_are_dealt_in_parts(spark, many, notes, monkeypatch, ambiguity):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    monkeypatch.setattr(hops, "PART_ROWS", 100, raising=False)
    try:
        for k, v in zip(before, ("false", "16", "-1"), strict=True):
            spark.conf.set(k, v)
        out = run_query(many, {"select": [{"name": "to", "expr": f"link.asFile({{'ambiguity': '{ambiguity}'}}).title"}]}, targets=notes)
        assert {(r.to, r["count"]) for r in out.results.groupBy("to").count().collect()} == {("Alpha", 2000), (None, 6000)}
        assert out.results.select("path").distinct().count() == 8000
        # counting the records found keeps the join
        sizes = [r.n for r in out.matches.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count("__hop0")).collect()]
        assert sum(sizes) == 8000 and max(sizes) < 1500
        if ambiguity == "unique":
            assert out.diagnostics.count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("options", ["", "{'types': ['source']}"])
def test_targets_of_packed_files_are_dealt_and_not_broadcast(spark, many, notes, tmp_path, options):
    """A small file may hold many targets: none is broadcast for its file's size, and no task sorts all that it reads of one."""
    from dataclasses import replace

    notes.df.coalesce(1).write.parquet(f"{tmp_path}/notes")
    many.df.coalesce(1).write.parquet(f"{tmp_path}/many")
    packed = replace(notes, df=spark.read.parquet(f"{tmp_path}/notes"))
    linking = replace(many, df=spark.read.parquet(f"{tmp_path}/many"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "256k"), strict=True):
            spark.conf.set(k, v)
        out = run_query(linking, {"select": [{"name": "to", "expr": f"link.asFile({options}).title"}]}, targets=packed)
        assert {(r.to, r["count"]) for r in out.results.groupBy("to").count().collect()} == {("Alpha", 2000), (None, 6000)}
        plan = out.results._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    def met(node):
        while node.children().size() == 1 and "Exchange" not in node.nodeName():
            node = node.children().apply(0)
        return node.nodeName()

    nodes = list(walk(plan))
    # popular links alone, once for the rows and once for the links
    assert sum(n.nodeName() == "BroadcastHashJoin" for n in nodes) == 2
    groups = [met(n) for n in nodes if n.nodeName() == "SortAggregate"]
    assert groups and not [g for g in groups if g.startswith("Scan")]
