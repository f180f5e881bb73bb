"""Order, pages and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def enum_order(value: Column, declared: list[str]) -> Column:
    """Sort key of an enum: its place in the declaration; unknown values and nulls last."""
    at = F.array_position(F.array(*[F.lit(x) for x in declared]), value)
    return F.when(at.isNull() | (at == 0), len(declared) + 1).otherwise(at)


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order; with a limit Spark keeps a bounded top only."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], boundary: list | None, limit: int) -> DataFrame:
    """The ``limit`` rows after a boundary row. ``keys`` are (column, descending), the last unique and never null.

    Nulls are last ascending and first descending. The boundary is a filter on
    columns, so a page costs no more however far down it is.
    """
    if boundary is not None:
        after, same = F.lit(False), F.lit(True)
        for (name, desc), value in zip(keys, boundary, strict=True):
            c = F.col(name)
            if value is None:
                later = c.isNotNull() if desc else F.lit(False)
                equal = c.isNull()
            else:
                later = (c < F.lit(value)) if desc else (c > F.lit(value)) | c.isNull()
                equal = c == F.lit(value)
            after = after | (same & F.coalesce(later, F.lit(False)))
            same = same & F.coalesce(equal, F.lit(False))
        df = df.where(after)
    return df.orderBy(*[F.col(n).desc_nulls_first() if d else F.col(n).asc_nulls_last() for n, d in keys]).limit(limit)


def late_page(narrow: DataFrame, payload: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Sort and cut narrow rows first, then fetch the payload of those that remain."""
    top = narrow.orderBy(*order).limit(limit)
    return top.join(payload, key, "left")


def read_many(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows by key in the order asked for; repeated keys repeat, unknown ones give nulls. ``slot`` is the place."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    slots = spark.createDataFrame(list(enumerate(wanted)), f"slot long, wanted {kind}")
    found = df.where(F.col(key).isin(list(set(wanted)))) if len(wanted) <= 1000 else df
    return slots.join(found, slots["wanted"] == found[key], "left").orderBy("slot")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    """Rows numbered from 1 within groups."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def pin(df: DataFrame, order: list[Column], path: str) -> DataFrame:
    """A result fixed as a table with its places, for cursors that must not see later changes. Numbered in ranges."""
    from folioquery.operators.quality import generate_sequence

    generate_sequence(df.withColumn("place", F.lit(None).cast("long")), "place", order, start=0).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def pinned_page(pinned: DataFrame, start: int, size: int = 100) -> DataFrame:
    """A page of a pinned result: a range of places, whatever the page."""
    return pinned.where(F.col("place").between(start, start + size - 1)).orderBy("place")
