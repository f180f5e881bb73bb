"""Candidate predicates, lifecycle actions, schemas and pinned results."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators import paging
from folioquery.operators.frame import from_table
from folioquery.operators.lifecycle import Action, digest, fields_of_schema, run_actions
from folioquery.plans.candidates import candidate, safe_literal
from folioquery.plans.compiler import Scope, Val, compiler
from folioquery.plans.syntax import ExpressionError
from folioquery.values import DYNAMIC


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ["open", "done", None][i % 3], i % 7, f'{{"s": "{"abc"[i % 3]}", "n": {i % 4}}}') for i in range(42)]
    df = spark.createDataFrame(data, "id long, status string, n long, v string")
    return from_table(df, "t", "id").with_fields(v=Val(F.try_parse_json("v"), DYNAMIC))


@pytest.mark.parametrize("where", [
    "status == 'open'", "!(status == 'open')", "status == 'open' && n / (n - 3) > 1", "status == 'open' || n > 4", "status == 'open' || n / (n - 3) > 1", "!(status == 'open' || n < 3)",
    "n in [1, 2] && status != 'done'", "3 < n", "v.s == 'a' && n > 2", "v.n == 2", "true && file.inFolder('t')", "!(n > 2 && v.n > 1)", "status in ['open'] || false",
])
def test_candidates_lose_no_match(rows, where):
    c = compiler("cel", Scope(dict(rows.fields), rows.bindings()))
    exact = {r.id for r in rows.df.where(c.truth(c.text(where))).collect()}
    early = candidate(rows, where)
    kept = {r.id for r in (rows.df if early is None else rows.df.where(early)).collect()}
    assert exact <= kept


def test_candidates_narrow_what_they_can(rows):
    assert candidate(rows, "status == 'open' || n / (n - 3) > 1") is None
    assert rows.df.where(candidate(rows, "status == 'open' && n / (n - 3) > 1")).count() < 42
    assert safe_literal("open") and not any(map(safe_literal, ["12", "2024-01-01", "true", "", ".5", 7]))


def test_actions_read_what_was_before(rows):
    r = run_actions(rows, [Action({"n": {"literal": 100}, "m": {"copy": "n"}}, "id < 2"), Action({"day": "today", "id2": "uuid"})], now="2024-05-06T10:00:00Z")
    out = {x.id: x for x in r.df.select("id", *[r.fields[k].col.alias(k) for k in ("n", "m", "day", "id2")]).where("id < 3").collect()}
    assert (out[1].n, out[1].m) == (100, 1) and (out[2].n, out[2].m) == (2, None) and str(out[2].day) == "2024-05-06" and len(out[1].id2) == 36
    with pytest.raises(ExpressionError):
        run_actions(rows, [Action({"x": {"shout": "n"}})], now="2024-05-06T10:00:00Z")


def test_schemas_and_digests():
    schema = {"required": ["a"], "properties": {"a": {"type": "string", "minLength": 2, "pattern": "^x"}, "b": {"enum": [1, 2]}, "c": {"type": "string", "format": "date"}, "d": {"type": "array", "maxItems": 3, "uniqueItems": True}}}
    f = fields_of_schema(schema)
    assert f["a"].required and f["a"].min_length == 2 and f["b"].type == "enum" and f["c"].type == "date" and f["d"].max_length == 3 and f["d"].unique_items
    assert digest({"b": 1, "a": "é"}) == digest({"a": "é", "b": 1}) != digest({"a": "é", "b": 2})


def test_pinned_results(rows, tmp_path):
    pinned = paging.pin(rows.df.select("id", "n"), [F.col("n"), F.col("id")], f"{tmp_path}/pin")
    want = [r.id for r in rows.df.orderBy("n", "id").collect()]
    assert [r.id for start in range(0, 42, 10) for r in paging.pinned_page(pinned, start, 10).collect()] == want
