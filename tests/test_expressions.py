"""Dialects: parsing, operators, libraries, and where they differ."""

import pytest
from pyspark.sql import functions as F

from folioquery.plans.compiler import Scope, Val, compiler
from folioquery.plans.syntax import CEL, PLAIN, VIEW, Binary, ExpressionError, Lit, Name, Ternary, Unary, in_order, parse, references
from folioquery.values import kind_of

ROW = "n long, z long, f double, s string, nil string, b boolean, xs array<long>, words array<string>, empty array<long>, d date, t timestamp, m struct<a:long,b:string>, v string"
VALUES = (7, 0, 2.5, "héllo Wörld", None, True, [3, 1, 2], ["b", "a", "b"], [], "2024-01-31", "2024-02-29 13:05:09", (1, "x"), '{"a": 1, "q": null, "t": "x", "l": [1, 2]}')


@pytest.fixture(scope="module")
def frame(spark):
    names = [c.split()[0] for c in ROW.split(", ")]
    texts = spark.createDataFrame([VALUES], ROW.replace("d date", "d string").replace("t timestamp", "t string"))
    df = texts.withColumns({"d": F.col("d").cast("date"), "t": F.col("t").cast("timestamp"), "v": F.try_parse_json("v")})
    return df, {n: Val(F.col(n), kind_of(df.schema[n].dataType)) for n in names}


def evaluate(frame, dialect, exprs, **scope):
    df, fields = frame
    c = compiler(dialect, Scope(fields, {"file": {"folder": Val(F.lit("a/b"), fields["s"].kind), "tags": Val(F.array(F.lit("x/y"), F.lit("z")), fields["words"].kind)}}, **scope))
    vals = [c.text(e) for e in exprs]
    show = lambda v: F.to_json(v.col) if v.kind.name in ("dynamic", "map") else v.col.cast("string") if v.kind.name in ("date", "timestamp") else v.col
    row = df.select(*[show(v).alias(f"v{i}") for i, v in enumerate(vals)], *[(F.lit(None) if v.err is None else v.err).cast("string").alias(f"e{i}") for i, v in enumerate(vals)]).first()
    return [row[f"v{i}"] for i in range(len(exprs))], [row[f"e{i}"] for i in range(len(exprs))]


def check(frame, dialect, cases, **scope):
    got, _ = evaluate(frame, dialect, list(cases), **scope)
    assert dict(zip(cases, got, strict=True)) == cases


def test_precedence():
    assert parse("a || b && c") == Binary("||", Name("a"), Binary("&&", Name("b"), Name("c")))
    assert parse("1 + 2 * 3 == 7 ? x : -y") == Ternary(Binary("==", Binary("+", Lit(1), Binary("*", Lit(2), Lit(3))), Lit(7)), Name("x"), Unary("-", Name("y")))
    # comparison and equality share a level in views and differ in the plain dialect
    assert parse("a == b < c", VIEW) == Binary("<", Binary("==", Name("a"), Name("b")), Name("c"))
    assert parse("a == b < c", PLAIN) == Binary("==", Name("a"), Binary("<", Name("b"), Name("c")))
    assert parse("a ?? b || c", PLAIN) == Binary("??", Name("a"), Binary("||", Name("b"), Name("c")))


@pytest.mark.parametrize("text, grammar", [("a ? b : c", VIEW), ("a in b", VIEW), ("a ?? b", CEL), ("1 +", CEL), ("(a", CEL), ("a b", CEL), ("#", CEL), ("'open", CEL)])
def test_refused(text, grammar):
    with pytest.raises(ExpressionError):
        parse(text, grammar)


def test_limits():
    with pytest.raises(ExpressionError) as e:
        parse("(" * 200 + "1" + ")" * 200)
    assert e.value.code == "expression_depth_exceeded"
    with pytest.raises(ExpressionError) as e:
        parse("'" + "x" * 70_000 + "'")
    assert e.value.code == "expression_source_limit_exceeded"


def test_dependencies():
    needs = {k: references(parse(x), "projection") for k, x in {"c": "projection.b + 1", "a": "1", "b": "projection.a"}.items()}
    assert in_order(needs) == ["a", "b", "c"]
    with pytest.raises(ExpressionError):
        in_order({"a": {"b"}, "b": {"a"}})
    with pytest.raises(ExpressionError):
        in_order({"a": {"zz"}})


def test_canonical(frame):
    check(frame, "cel", {
        "n + 1": 8, "n / 2": 3, "n % 4": 3, "f * 2.0": 5.0, "s.size()": 11, "'a' + s": "ahéllo Wörld", "n in [1, 7]": True, "nil == null": True, "nil in ['a']": False,
        "xs.filter(x, x > 1)": [3, 2], "xs.map(x, x * 2)": [6, 2, 4], "xs.all(x, x > 0)": True, "xs.exists_one(x, x == 2)": True, "xs.map(x, x > 1, x * 10)": [30, 20], "has(m.a)": True,
        "dayOfWeek(d)": 3, "addMonths(d, 1)": "2024-02-29", "addYears(date('2024-02-29'), 1)": "2025-02-28", "daysUntil(d, date('2024-02-10'))": 10, "year(t)": 2024,
        "n > 5 ? 'big' : 'small'": "big", "s.matches('W.r')": True, "xs + [4]": [3, 1, 2, 4], "int('12')": 12, "v.a == 1": True, "v.t == 'x'": True, "has(v.q)": True, "has(v.zz)": False,
        "unknown == null": True, "t - duration('90m') < t": True, "startOfDay(t)": "2024-02-29 00:00:00", "'2024-1-1' == s": False, "n == 7.0": True, "s == 7": False,
        "file.inFolder('a')": True, "file.inFolder('')": False, "file.hasTag('x')": True, "file.hasTag('y')": False, "xs[0]": 3, "type(n)": "int",
    })


def test_canonical_errors_are_values(frame):
    got, err = evaluate(frame, "cel", ["n / z", "nil > 3", "z == 1 || n / z > 1", "n == 7 || n / z > 1", "z == 1 && n / z > 1", "xs[9]", "s + 1", "m.zz", "date('2024-02-30')", "9223372036854775807 + n"])
    assert got == [None, None, None, True, False, None, None, None, None, None]
    assert [e is not None for e in err] == [True, True, True, False, False, True, True, True, True, True]
    assert err[0] == "division by zero" and err[5] == "index out of bounds" and err[9] == "overflow"


def test_plain(frame):
    check(frame, "plain", {
        "n / z": None, "n % z": None, "nil + 1": None, "n && s": '"héllo Wörld"', "nil || 'd'": "d", "nil ?? 'd'": "d", "s.length()": 13, "!empty": True, "s.upper()": "HÉLLO WÖRLD",
        "dayOfWeek(d)": 3, "s.slice(-5)": "Wörld", "s.split(' ')[1]": "Wörld", "s.title()": "Héllo Wörld", "words.unique()": ["b", "a"], "xs.sort()": [1, 2, 3], "xs[-1]": 2, "xs[9]": None,
        "xs.reduce(acc + value, 0)": 6.0, "xs.filter(value > 1)": [3, 2], "words.join()": "b,a,b", "words.containsAll('a', 'b')": True, "words.containsAny('q', 'b')": True,
        "round(2.5)": 3, "floor(f)": 2, "ceil(f)": 3, "min(n, 3)": 3, "min(n, nil)": None, "if(n, 'y', 'z')": "y", "n in xs": False, "d + '1 month'": "2024-02-29",
        "t + '26h'": "2024-03-01 15:05:09", "'1 month' + d": "2024-02-29", "d - '1y'": "2023-01-31", "'2024-01-31' + '1 month'": "2024-02-29", "'2024-02-29T13:05:09Z' + '1d'": "2024-03-01T13:05:09Z",
        "'2024-01-31' - '30d'": "2024-01-01", "'2024-01-31' + 'x'": None, "s + '!'": "héllo Wörld!", "s + n": "héllo Wörld7", "nil + 'x'": "nullx", "nil + nil": None, "xs + 1": None,
        "duration('1 month')": 2_592_000_000, "duration('1y') / duration('1d')": 365.0, "duration('PT1H')": 3_600_000, "duration('soon')": None, "t - datetime('2024-02-29T13:05:08')": 1000, "date('2024-05-06T10:00')": "2024-05-06",
        "t.format('YYYY/MM/DD HH:mm')": "2024/02/29 13:05", "'a-b'.replace('-', '$1')": "a$1b", "'  x\t'.trim()": "x", "'Ab C!'.slugify()": "ab-c", "s.reverse()": "dlröW olléh", "number('12.5')": 12.5,
    })


def test_filters_refuse_to_join_texts_with_other_values(spark):
    from folioquery.operators.frame import from_table
    from folioquery.plans.plain_query import run_plain_query

    records = from_table(spark.createDataFrame([(1, "a", "2024-01-31"), (2, None, "b")], "id long, s string, d string"), "t", "id")
    kept = lambda where: [r.id for r in run_plain_query(records, {"where": where, "sort": "id"}).results.collect()]
    assert kept("s + 1 == 'a1'") == [] and kept("s + 'x' == 'ax'") == [1] and kept("s + 'x' == 'nullx'") == []
    assert kept("d + '1 month' == '2024-02-29'") == [1] and kept("d + '!' == 'b!'") == [2]


def test_views(frame):
    check(frame, "view", {
        "n / z": None, "unknown + 1": 1.0, "s + 1": "héllo Wörld1", "!empty": False, "s.length": None, "length(s)": 11, "nil && n": False, "n && s": True, "random()": 0.5, "f.toFixed(0)": "2",
        "(0.25).toFixed(1)": "0.2", "xs.sum()": 6.0, "xs.mean()": 2.0, "/w.r/i.matches(s)": True, "s.replace(/l/g, 'L')": "héLLo WörLd", "s.replace(/l/, 'L')": "héLlo Wörld", "words.join('+')": "b+a+b",
        "date('bad')": "1970-01-01", "n == 7": True, "nil < 1": False, "round(2.456, 1)": 2.5, "'<a>'.escapeHTML()": "&lt;a&gt;", "if(empty, 1, 2)": 1.0, "words.first()": "b", "xs.map(value + index)": [3.0, 2.0, 4.0],
    })


def test_time_zones_and_clock(frame):
    check(frame, "cel", {"today()": "2024-03-10", "startOfDay(timestamp('2018-11-04T12:00:00Z'))": "2018-11-04 03:00:00"}, timezone="America/Sao_Paulo", now="2024-03-11T01:00:00Z")


def test_unknown_names_and_functions(frame):
    df, fields = frame
    for text, code in (("nope(1)", "unknown_function"), ("projection.x", "invalid_query"), ("this.a", "invalid_query"), ("s.startsWith()", "wrong_argument_count")):
        with pytest.raises(ExpressionError) as e:
            compiler("cel", Scope(fields)).text(text)
        assert e.value.code == code


def test_the_clock_runs_and_stands_within_a_query(spark):
    import datetime

    from folioquery.operators.frame import from_table
    from folioquery.plans.query import run_query

    today = datetime.datetime.now(datetime.UTC).date()
    due = [(1, today - datetime.timedelta(days=400)), (2, today + datetime.timedelta(days=400))]
    records = from_table(spark.createDataFrame(due, "id long, due date"), "t", "id")
    assert [r.id for r in run_query(records, {"where": "due < today()", "select": ["id"]}).results.collect()] == [1]
    assert run_query(records, {"where": "now() == now()"}).total_count() == 2
    assert run_query(records, {"where": "due < today()", "now": "1970-01-01T00:00:00Z"}).total_count() == 0
