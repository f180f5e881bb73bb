"""Queries, groups, views, links, types, quality, differences, events and sources."""

import json

import pytest
from pyspark.sql import functions as F

from folioquery.operators import diff, links, paging, quality, types
from folioquery.operators.frame import from_table
from folioquery.operators.types import Field, TypeDef
from folioquery.plans.plain_query import run_plain_query
from folioquery.plans.query import run_query
from folioquery.plans.syntax import ExpressionError
from folioquery.plans.views import merge, run_view
from folioquery.sources import markdown
from folioquery.streaming import events


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [("a", "A", None, 2, [1], True), ("b", "B", "done", 5, [], False), ("c", "C", "done", None, [1, 2], None), ("d", "", "10", 1, None, True), ("e", "E", "2", 4, [3], False)]
    return from_table(spark.createDataFrame(rows, "id string, title string, status string, estimate long, xs array<long>, ok boolean"), "task", "id")


def ids(df):
    return [r.id for r in df.collect()]


def test_nulls_sort_last_up_and_first_down(tasks):
    up = run_query(tasks, {"select": ["id"], "order_by": [{"field": "status"}]}).results
    down = run_query(tasks, {"select": ["id"], "order_by": [{"field": "status", "direction": "desc"}]}).results
    assert ids(up) == ["d", "e", "b", "c", "a"] and ids(down) == ["a", "b", "c", "e", "d"]
    by_size = run_query(tasks, {"select": ["id"], "order_by": [{"field": "xs"}]}).results
    assert ids(by_size) == ["b", "a", "e", "c", "d"]


def test_where_keeps_true_only_and_reports_the_rest(tasks):
    out = run_query(tasks, {"where": "10 / (estimate - 2) > 2", "select": ["id"], "limit": 1})
    assert ids(out.results) == ["b"] and out.total_count() == 2 - 1 + 1 and out.has_more()
    problems = {(r.path, r.context): r.message for r in out.diagnostics.collect()}
    assert problems[("task/a", "query_filter")] == "division by zero" and ("task/c", "query_filter") in problems
    assert run_query(tasks, {"where": "title"}).matches.count() == 0  # no boolean


def test_groups_and_summaries(tasks):
    out = run_query(tasks, {
        "limit": 1, "group_by": [{"field": "status", "direction": "desc"}], "summary_functions": {"list": "values.map(v, v == null ? -1 : v)"},
        "summaries": [{"name": n, "field": f, "function": n} for n, f in (("sum", "estimate"), ("empty", "xs"), ("latest", "title"), ("filled", "title"), ("list", "estimate"))] + [{"name": "poison", "field": "title", "function": "sum"}],
    }).groups.collect()
    assert [r.status for r in out] == [None, "done", "2", "10"]
    done = out[1]
    assert (done["count"], done["sum"], done["empty"], done["latest"], done["filled"], done["poison"]) == (2, 5, 1, "C", 2, None)
    assert sorted(done["list"]) == [-1, 5]
    whole = run_query(tasks, {"where": "false", "summaries": [{"name": "s", "field": "estimate", "function": "sum"}]}).groups.collect()
    assert [(r["count"], r["s"]) for r in whole] == [(0, None)]


@pytest.mark.parametrize("bad", [
    {"nope": 1}, {"select": ["id", "x.id"]}, {"projections": {"a": {"expr": "projection.b"}}}, {"projections": {"a": {"expr": "projection.a"}}}, {"limit": -1},
    {"include_body": True, "output": "metadata"}, {"summaries": [{"field": "id", "function": "median"}]}, {"where": "values.size() > 1"}, {"select": ["projection.none"]},
])
def test_bad_queries_are_refused(tasks, bad):
    with pytest.raises(ExpressionError):
        run_query(tasks, bad)


def test_this_is_bound_to_all_rows(spark, tasks):
    from folioquery.plans.compiler import literal

    assert ids(run_query(tasks, {"where": "status == this.status", "select": ["id"]}, this={"status": literal("done")}).results) == ["b", "c"]


def test_plain_queries(tasks):
    out = run_plain_query(tasks, {"where": "ok && estimate", "order_by": ["estimate"], "property_summaries": {"estimate": "Sum", "status": "Unique", "xs": "Empty", "ok": "Checked"}})
    assert ids(out.results) == ["d", "a"]
    row = out.summaries.first()
    assert (row.estimate, row.status, row.xs, row.ok) == (3.0, 2, 1, 2)
    groups = run_plain_query(tasks, {"groupBy": {"property": "status"}, "limit": 1}).groups.collect()
    assert [(g.value, g["count"]) for g in groups] == [("10", 1), ("2", 1), ("done", 2), (None, 1)]
    down = run_plain_query(tasks, {"groupBy": {"property": "status", "direction": "DESC"}}).groups.collect()
    assert [g.value for g in down] == [None, "done", "2", "10"]
    nothing = run_plain_query(tasks, {"where": {"neither": []}, "property_summaries": {"estimate": "Sum", "title": "Latest"}})
    assert tuple(nothing.summaries.first()) == (0.0, None)
    assert ids(run_plain_query(tasks, {"where": {"and": ["estimate > 1", {"not": "status == 'done'"}], "or": ["false"]}}).results) == ["a", "e"]
    assert ids(run_plain_query(tasks, {"where": {"or": ["ext::near(id)", "id == 'a'"]}}).results) == ["a"]
    with pytest.raises(ExpressionError):
        run_plain_query(tasks, {"where": "nope(id)"})
    enum = run_plain_query(tasks, {"order_by": ["status"]}, enums={"status": ["done", "2"]}).results
    assert ids(enum) == ["b", "c", "e", "a", "d"]


VIEW = {
    "filters": {"and": ['status != "10"'], "not": ['title == "E"']},
    "formulas": {"double": "estimate * 2", "next": "formula.double + 1"},
    "views": [{"name": "v", "filters": 'file.path.contains("task/")', "order": ["id", "formula.next"], "sort": [{"property": "estimate", "direction": "DESC"}], "groupBy": "status", "limit": 2}],
}


def test_views(tasks):
    out = run_view(tasks, VIEW, "v")
    assert [(r.id, r.next) for r in out.results.collect()] == [("c", 1.0), ("b", 11.0)]
    assert [(r.value, r["count"]) for r in out.groups.collect()] == [('"done"', 2), ("null", 1)]
    with pytest.raises(ExpressionError):
        run_view(tasks, VIEW, "other")
    merged = merge({"where": "a || b", "types": ["x", "y"], "projections": {"p": "1"}}, {"name": "n", "where": "c", "types": ["y", "z"], "limit": 3})
    assert merged == {"where": "(a || b) && (c)", "types": ["y"], "projections": {"p": "1"}, "limit": 3}
    with pytest.raises(ExpressionError):
        merge({"projections": {"p": "1"}}, {"projections": {"p": "2"}})


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(30)], "id long, k long")
    for desc in (False, True):
        keys = [("k", desc), ("id", False)]
        whole = [tuple(r) for r in df.orderBy(F.col("k").desc_nulls_first() if desc else F.col("k").asc_nulls_last(), "id").select("k", "id").collect()]
        seen, boundary = [], None
        while rows := paging.keyset_page(df, keys, boundary, 7).collect():
            seen += [(r.k, r.id) for r in rows]
            boundary = list(seen[-1])
        assert seen == whole
    many = paging.read_many(df, "id", [3, 99, 3]).collect()
    assert [(r.slot, r.id) for r in many] == [(0, 3), (1, None), (2, 3)]


RECORDS = [
    ("notes/alpha.md", "n1", "Alpha"), ("other/alpha.md", None, None), ("deep/er/alpha.md", None, None), ("books/one.md", "bk", "The One"), ("books/two.md", "dup", "Twice"),
    ("x/three.md", "dup", "Twice"), ("books/dup.md", None, None), ("notes/beta.md", None, "Solo"),
]


def test_resolution(spark):
    records = spark.createDataFrame(RECORDS, "path string, id string, title string")
    cases = {
        "[[alpha]]": ("notes/alpha.md", None), "[[bk]]": ("books/one.md", None), "[[The One]]": ("books/one.md", None), "[[Solo|shown]]": ("notes/beta.md", None),
        "[[dup]]": (None, "ambiguous"), "[[Twice]]": (None, "ambiguous"), "[[one.md#part]]": ("books/one.md", None), "one.md": (None, "missing"), "beta.md": ("notes/beta.md", None), "beta": ("notes/beta.md", None),
        "../books/two.md": ("books/two.md", None), "/x/three": ("x/three.md", None), "[[books/two]]": ("books/two.md", None), "[t](./beta.md)": ("notes/beta.md", None), "https://e.org/a": (None, "external"),
        "[[nothing]]": (None, "missing"), "../../up.md": (None, "missing"), "[[ALPHA]]": ("notes/alpha.md", None),
        "[[BK]]": ("books/one.md", None), "[[the one]]": ("books/one.md", None), "[[TWICE]]": (None, "ambiguous"),
    }
    asked = spark.createDataFrame([("notes/origin.md", c) for c in cases], "source_path string, raw_target string")
    got = {r.raw_target: (r.target_path, r.reason) for r in links.resolve(asked, records).collect()}
    assert got == cases
    unique = {r.raw_target: (r.target_path, r.reason) for r in links.resolve(asked, records, unique=True).collect()}
    assert unique == {**cases, "[[alpha]]": (None, "ambiguous"), "[[ALPHA]]": (None, "ambiguous")}


def test_typed_resolution(spark):
    records = spark.createDataFrame([("a/x.md", None, None, ["note"]), ("b/x.md", None, None, ["task"])], "path string, id string, title string, types array<string>")
    asked = spark.createDataFrame([("a/o.md", "[[x]]", ["task"]), ("a/o.md", "x.md", ["task"]), ("a/p.md", "[[x]]", None)], "source_path string, raw_target string, target_types array<string>")
    got = {(r.source_path, r.raw_target): r.target_path for r in links.resolve(asked, records).collect()}
    assert got == {("a/o.md", "[[x]]"): "b/x.md", ("a/o.md", "x.md"): None, ("a/p.md", "[[x]]"): "a/x.md"}


def test_edges(spark):
    edges = spark.createDataFrame([("a", "t"), ("b", "t"), ("a", "t"), ("c", None)], "source_path string, target_path string")
    assert [(r.target_path, r.sources, r.n_sources) for r in links.backlinks(edges).collect()] == [("t", ["a", "b"], 2)]
    renames = spark.createDataFrame([("d/old.md", "d/new name.md")], "old_path string, new_path string")
    hit = spark.createDataFrame([("s", "[[old|x]]", "d/old.md"), ("s", "[[d/old#h]]", "d/old.md"), ("s", "old.md", "d/old.md"), ("s", "[[z]]", "z.md")], "source_path string, raw_target string, target_path string")
    assert [r.new_target for r in links.rename_references(hit, renames).orderBy("raw_target").collect()] == ["[[d/new name#h]]", "[[new name|x]]", "d/new name.md"]
    owners = spark.createDataFrame([(1, ["x", "nope", "y"]), (2, [])], "id long, ls array<string>")
    named = spark.createDataFrame([("x", 10), ("y", 20)], "k string, v long")
    assert {r.id: r.vals for r in links.follow_each(owners, "id", "ls", named, "k", "v", "vals").collect()} == {1: [10, None, 20], 2: None}


def test_extraction():
    body = "[[one|x]] ![[pic.png]] [t [n] u](a(1).md) `[[no]]`\n```\n[[no]] #no\n```\n#tag/sub #fff #123 a#b #tag/sub"
    assert links.extract(body) == [("body", "[[one|x]]"), ("embed", "[[pic.png]]"), ("body", "a(1).md")]
    assert links.extract_tags(body) == ["tag/sub"] and links.extract("") == [] and links.extract(None) == []


@pytest.mark.parametrize("pattern, path, hit", [
    ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("x/**", "x/y/z", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[ab].md", "b.md", True), ("[!ab].md", "b.md", False), ("[!ab].md", "c.md", True), ("A.md", "a.md", False), ("a.b", "axb", False),
])
def test_globs(spark, pattern, path, hit):
    import re

    assert bool(re.match(types.glob_regex(pattern).replace(r"\z", r"\Z"), path)) is hit


def test_types(tasks):
    defs = types.inherited({"kid": TypeDef("kid", {"x": Field("integer")}, {"where": {"estimate": {"gte": 2, "lt": "9"}}}, extends="base"), "base": TypeDef("base", {"x": Field("string"), "y": Field()}, {"fields_present": ["status"], "path_glob": "task/*"}, strict="warn")})
    assert defs["kid"].fields["x"].type == "integer" and "y" in defs["kid"].fields and defs["kid"].strict == "warn"
    with pytest.raises(ExpressionError):
        types.inherited({"a": TypeDef("a", extends="b"), "b": TypeDef("b", extends="a")})
    r = types.classify(tasks, defs)
    got = {x.id: x.ts for x in r.df.select("id", r.types.alias("ts")).collect()}
    assert got == {"a": ["kid"], "b": ["base", "kid"], "c": ["base"], "d": ["base"], "e": ["base", "kid"]}
    assert types.conflicts(defs) == [("base", "kid", "x")]
    computed = types.with_computed(tasks, {"p": Field(computed="q + 1"), "q": Field(computed="estimate * 2")})
    assert [x[0] for x in computed.df.orderBy("id").select(computed.fields["p"].col).collect()] == [5, 11, None, 3, 9]


def test_validation(spark, tasks):
    fields = {"title": Field("string", required=True, min_length=1), "status": Field("enum", values=("done", "10")), "estimate": Field("integer", min=2, max=4), "xs": Field("list", min_length=1), "gone": Field(required=True)}
    got = {(r.path, r.field, r.code) for r in quality.validate(tasks, fields, strict="error").collect()}
    assert {g for g in got if g[1] not in ("gone", "id", "ok")} == {("task/d", "title", "too_short"), ("task/e", "status", "not_in_enum"), ("task/b", "estimate", "above_maximum"), ("task/d", "estimate", "below_minimum"), ("task/b", "xs", "too_short")}
    assert ("task/a", "gone", "missing_required") in got and ("task/a", "id", "unknown_field") in got and ("task/c", "ok", "unknown_field") not in got
    clash = quality.uniqueness_conflicts(tasks, "status").collect()
    assert {(r.path, r.n_records) for r in clash} == {("task/b", 2), ("task/c", 2)}
    seq = quality.generate_sequence(spark.createDataFrame([(i, 5 if i == 3 else None) for i in range(20)], "id long, n long"), "n", [F.col("id")])
    assert [r.n for r in seq.orderBy("id").collect()] == [6, 7, 8, 5, *range(9, 25)]
    assert tasks.df.select(quality.derive_path("{status}/{id}.md", {"status": F.col("status"), "id": F.col("id")}).alias("p")).orderBy("p").first().p is None


def test_batches(spark):
    df = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r2")], "id long, v string, revision string")
    changes = "op string, id long, v string, revision string, if_revision string"
    good = spark.createDataFrame([("update", 1, "A", "r3", "r1"), ("create", 3, "c", "r4", None), ("delete", 2, None, None, None)], changes)
    out, refused = quality.apply_batch(df, "id", good)
    assert {(r.id, r.v) for r in out.collect()} == {(1, "A"), (3, "c")} and refused.count() == 0
    bad = spark.createDataFrame([("update", 1, "A", "r3", "old"), ("create", 2, "c", "r4", None), ("delete", 9, None, None, None), ("create", 4, "d", "r5", None)], changes)
    out, refused = quality.apply_batch(df, "id", bad)
    assert out.count() == 2 and {r.refused for r in refused.collect()} == {"revision_conflict", "already_exists", "not_found"}
    out, _ = quality.apply_batch(df, "id", bad, atomic=False)
    assert {r.id for r in out.collect()} == {1, 2, 4}


def test_snapshot_diff(spark):
    kind = "path string, revision string, title string"
    old = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("c", "3", "t"), ("d", "9", "t"), ("e", "9", "t"), ("k", "7", "t")], kind)
    new = spark.createDataFrame([("a", "1", "t"), ("b", "x", "u"), ("c2", "3", "t"), ("d2", "9", "t"), ("n", "5", "t"), ("k", "7", "t")], kind)
    got = {(r.event_type, r.path, r.previous_path, tuple(r.changed_fields or ())) for r in diff.snapshot_diff(old, new, fields=["title"]).collect()}
    assert got == {("modified", "b", None, ("title",)), ("renamed", "c2", "c", ()), ("deleted", "d", None, ()), ("deleted", "e", None, ()), ("created", "d2", None, ()), ("created", "n", None, ())}
    own = spark.createDataFrame([("b", "x")], "path string, new_revision string")
    assert diff.suppress_known(diff.snapshot_diff(old, new), own).where("path = 'b'").count() == 0


def brute_throttle(rows, seconds):
    last, out = {}, set()
    for i, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if u not in last or t >= last[u] + seconds:
            last[u] = t
            out.add(i)
    return out


def test_events(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i % 4 if i % 3 else 0, rng.randrange(5000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, user long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.id for r in events.throttle(df, "user", "ts", "id", 60).collect()} == brute_throttle(rows, 60)
    by = {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(u, []).append((t, i))
    quiet = {i for v in by.values() for (t, i), n in zip(v, [*v[1:], (10**9, 0)], strict=True) if n[0] >= t + 30}
    assert {r.id for r in events.debounce(df, "user", "ts", "id", 30).collect()} == quiet
    modes = {m: {r.id for r in events.concurrency(df, "user", [F.col("t"), F.col("id")], m).where("outcome = 'run'").collect()} for m in ("allow", "skip", "replace")}
    assert len(modes["allow"]) == 400 and modes["skip"] == {v[0][1] for v in by.values()} and modes["replace"] == {v[-1][1] for v in by.values()}
    feed = events.ordered_feed(df.select("id"), 100, [F.col("id")])
    assert [r.watermark for r in feed.orderBy("id").collect()] == list(range(101, 501))


def test_streams(spark, tmp_path):
    rows = [(i, i % 2, i * 10_000_000) for i in range(20)]
    spark.createDataFrame(rows, "id long, user long, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, user long, at long").parquet(f"{tmp_path}/in")
    q = events.throttle_stream(stream, "user", 50).writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id for r in spark.table("throttled").collect()} == brute_throttle([(i, u, t // 1_000_000) for i, u, t in rows], 50)


def test_front_matter():
    assert markdown.parse(b"\xef\xbb\xbf---\r\na: 1\r\n---\r\nbody") == (None, '{"a": 1}', "body")
    assert markdown.parse(b"no fence") == (None, "{}", "no fence")
    assert markdown.parse(b"---\na: 1\nopen") == (None, "{}", "---\na: 1\nopen")
    assert markdown.parse(b"---\n---\nx") == (None, "{}", "x")
    assert [markdown.parse(x)[0] for x in (b"---\n- 1\n---\n", b"---\na: [\n---\n", b"\xff\xfe")] == ["non_mapping_frontmatter", "invalid_yaml", "invalid_utf8"]
    assert json.loads(markdown.parse(b"---\nx: .inf\n1: a\nd: 2024-01-02\n---\n")[1]) == {"x": ".inf", "d": "2024-01-02"}
    text = markdown.serialize({"b": 1, "a": ["x"]}, "body\n")
    assert json.loads(markdown.parse(text.encode())[1]) == {"b": 1, "a": ["x"]} and markdown.parse(text.encode())[2] == "body\n"


def test_collections(spark, tmp_path):
    files = {
        "tasks/a.md": "---\ntype: task\ntitle: A\nestimate: 2\noptional:\ntags: ['#p']\n---\nBody #alpha [[b]]", "tasks/b.md": "---\ntypes: [task, note]\nestimate: 5\n---\n", "tasks/bad.md": "---\ntype: task\nestimate: many\n---\n",
        "broken.md": "---\na: [\n---\n", "inner/collection.yaml": "x: 1", "inner/deep/c.md": "hidden", ".git/d.md": "no", "node_modules/e.md": "no", "drafts/f.md": "no", "g.txt": "no",
    }
    for name, text in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    df = markdown.read_collection(spark, str(tmp_path / "root"), exclude=("drafts/**",)).cache()
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {"tasks/a.md", "tasks/b.md", "tasks/bad.md", "broken.md"} and rows["broken.md"].invalid_reason == "invalid_yaml"
    assert rows["tasks/a.md"].tags == ["p", "alpha"] and rows["tasks/a.md"].links == ["[[b]]"] and rows["tasks/a.md"].revision.startswith("sha256:")
    r = markdown.collection_records(df, {"title": "string", "estimate": "any", "n": "integer"})
    out = run_query(r, {"types": ["TASK"], "projections": {"adj": {"expr": "estimate + 1.0"}}, "where": "projection.adj >= 3.0", "select": ["projection.adj"], "include_body": True})
    assert [(x.path, x.adj) for x in out.results.collect()] == [("tasks/a.md", 3.0), ("tasks/b.md", 6.0)]
    assert {(x.path, x.field) for x in out.diagnostics.collect()} >= {("tasks/bad.md", "projections.adj")}
    assert run_query(r, {"limit": 10}).total_count() == 4 and run_query(r, {"where": "true"}).total_count() == 3
    assert {x.path for x in df.where(markdown.key_present("optional")).collect()} == {"tasks/a.md"}
    markdown.write_collection(df.where("invalid_reason is null"), str(tmp_path / "copy"))
    again = {x.path: json.loads(x.raw_json) for x in markdown.read_collection(spark, str(tmp_path / "copy")).collect()}
    assert again["tasks/a.md"]["tags"] == ["#p"] and set(again) == set(rows) - {"broken.md"}


def test_debounce_stream_gives_closed_bursts(spark, tmp_path):
    rows = [(i, i % 2, (i * 7 + (100 if i >= 10 else 0)) * 1_000_000) for i in range(20)]
    spark.createDataFrame(rows, "id long, user long, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, user long, at long").parquet(f"{tmp_path}/in")
    q = events.debounce_stream(stream, "user", 30).writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the last of each key come only if the timeout passes while the stream runs
    assert {8, 9} <= {r.id for r in spark.table("quiet").collect()} <= {8, 9, 18, 19}


def test_stream_admission_and_windows(spark, tmp_path):
    rows = [(i % 6, i) for i in range(12)]
    spark.createDataFrame(rows, "id long, t long").withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, t long, ts timestamp").parquet(f"{tmp_path}/in")
    q = events.admit_stream(stream, ["id"], "ts", "1 hour").writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("admitted").collect()) == list(range(6))
    counts = events.windowed(stream, "ts", "5 seconds", "1 second", [], [F.count(F.lit(1)).alias("n")])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [2, 5, 5]
