"""Every registered query of the library against its SQL on DuckDB, over whole tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from folioquery.queries import ORACLE, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(list(v))
    if isinstance(v, dict):
        return plain(list(v.values()))
    return v if v is None or isinstance(v, bool | int | str) else str(v)


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(QUERIES)))
def test_query_equals_its_sql(spark, con, name):
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    out = QUERIES[name](spark, DATA)
    assert sorted(out.columns) == sorted(columns)
    got = sorted(str([plain(x) for x in r]) for r in out.select(*columns).collect())
    assert got == sorted(str([plain(x) for x in r]) for r in cur.fetchall())
