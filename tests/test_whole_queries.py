"""Queries over whole tables: every row is returned and compared with the SQL."""

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from folioquery.operators import quality  # noqa: E402
from folioquery.queries import ORACLE, QUERIES  # noqa: E402
from folioquery.streaming import events as ev  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["order_nulls_desc_whole", "order_multi_key_whole", "enum_order_whole", "view_merge_whole"])
def test_every_place_of_an_order_is_returned(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=lambda r: r[columns.index("place")])
    got = sorted((tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect()), key=lambda r: r[columns.index("place")])
    if name != "view_merge_whole":
        assert len(got) == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert got == want


@pytest.mark.parametrize("name", ["resolve_ranked_every_name", "resolve_unique_every_name"])
def test_every_name_is_resolved(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    got = [tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(cur.fetchall(), key=str)
    assert len(got) == con.execute("SELECT (SELECT count(*) FROM supplier) * 2 * (SELECT count(DISTINCT p_name) FROM part)").fetchone()[0]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sequences_are_dense_over_many_ranges(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        n = 1_000_000
        df = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
        feed = ev.ordered_feed(df, 50, [F.col("k"), F.col("id")])
        out = feed.agg(F.count(F.lit(1)), F.count_distinct("watermark"), F.min("watermark"), F.max("watermark")).first()
        assert tuple(out) == (n, n, 51, 50 + n)
        nxt = feed.select((F.col("watermark") - 1).alias("watermark"), F.struct("k", "id").alias("after"))
        assert feed.join(nxt, "watermark").where(F.struct("k", "id") >= F.col("after")).isEmpty()
        numbers = df.withColumn("number", F.when(F.col("id") < 10, F.col("id") + 7))
        out = quality.generate_sequence(numbers, "number", [F.col("id")]).agg(F.count_distinct("number"), F.max("number"), F.count(F.lit(1))).first()
        assert tuple(out) == (n, n + 6, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
