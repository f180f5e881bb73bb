"""Validation, uniqueness, generated values, backfill and batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.operators.types import Field
from folioquery.plans.compiler import Val
from folioquery.storage import materialise
from folioquery.values import STRING, canonical_json, dynamic_kind


def checks(name: str, f: Field, v: Val) -> list[tuple[str, Column]]:
    """Failing conditions of a field, by code. Null counts as missing and fails nothing but ``required``."""
    c = v.col
    text = F.try_variant_get(c, "$", "string") if v.kind.name == "dynamic" else c.cast("string")
    number = text.try_cast("double") if v.kind.name not in ("list", "map") else F.lit(None).cast("double")
    out: list[tuple[str, Column]] = []
    if f.required:
        out.append(("missing_required", c.isNull()))
    if f.deprecated:
        out.append(("deprecated", c.isNotNull()))
    kind = dynamic_kind(c) if v.kind.name == "dynamic" else F.lit({"int": "number", "float": "number"}.get(v.kind.name, v.kind.name))
    want = {"string": ("string",), "integer": ("number",), "number": ("number",), "boolean": ("bool",), "list": ("list",), "object": ("map",)}.get(f.type)
    if want:
        out.append(("type_mismatch", c.isNotNull() & ~kind.isin(*want, "null")))
    if f.type == "integer":
        out.append(("not_integer", number.isNotNull() & (number != F.floor(number))))
    if f.type == "enum":
        out.append(("not_in_enum", text.isNotNull() & ~text.isin(*f.values)))
    if f.type == "date":
        out.append(("invalid_date", text.isNotNull() & ~F.coalesce(F.rlike(text, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")) & text.try_cast("date").isNotNull(), F.lit(False))))
    if f.type == "datetime":
        out.append(("invalid_datetime", text.isNotNull() & F.try_to_timestamp(text).isNull()))
    if f.type == "time":
        out.append(("invalid_time", text.isNotNull() & ~F.rlike(text, F.lit(r"\A([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?\z"))))
    if f.min is not None:
        out.append(("below_minimum", number < f.min))
    if f.max is not None:
        out.append(("above_maximum", number > f.max))
    if f.pattern is not None:
        out.append(("pattern_mismatch", text.isNotNull() & ~F.rlike(text, F.lit(f.pattern))))
    size = F.size(c) if v.kind.name == "list" else F.char_length(text)
    if f.min_length is not None:
        out.append(("too_short", c.isNotNull() & (size < f.min_length)))
    if f.max_length is not None:
        out.append(("too_long", c.isNotNull() & (size > f.max_length)))
    if f.unique_items and v.kind.name == "list":
        out.append(("duplicate_items", F.size(F.array_distinct(c)) < F.size(c)))
    return [(code, F.coalesce(bad, F.lit(False))) for code, bad in out]


def validate(records: Records, fields: dict[str, Field], *, strict: str | None = None) -> DataFrame:
    """One row per failed check: ``path``, ``field``, ``code``, ``severity``. One pass, no shuffle."""
    found = []
    for name, f in fields.items():
        v = records.fields.get(name, Val(F.lit(None).cast("string"), STRING))
        for code, bad in checks(name, f, v):
            severity = "warning" if code == "deprecated" else "error"
            found.append(F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))))
    if strict in ("warn", "error"):
        for name in records.fields:
            if name not in fields:
                bad = records.fields[name].col.isNotNull()
                found.append(F.when(bad, F.struct(F.lit(name).alias("field"), F.lit("unknown_field").alias("code"), F.lit("warning" if strict == "warn" else "error").alias("severity"))))
    if not found:
        found = [F.lit(None).cast("struct<field:string,code:string,severity:string>")]
    hit = F.filter(F.array(*found), lambda x: x.isNotNull())
    return records.df.select(records.path.alias("path"), F.explode(hit).alias("d")).select("path", "d.field", "d.code", "d.severity")


def uniqueness_conflicts(records: Records, field: str, *, scope: Column | None = None) -> DataFrame:
    """Records whose value of a field another record of the scope has too. Nulls are exempt; values compare as text.

    Values are counted first, so a value that many records share moves as one row of
    each task; the join back is split by Spark where it is skewed.
    """
    v = records.fields[field]
    value = v.col.cast("string") if v.kind.name not in ("list", "map", "dynamic") else canonical_json(v.col, v.kind)
    rows = records.df.select(records.path.alias("path"), (F.lit("all") if scope is None else scope).alias("scope"), value.alias("value")).where("value is not null")
    shared = rows.groupBy("scope", "value").agg(F.count_distinct("path").alias("n_records")).where("n_records > 1")
    return rows.distinct().join(shared, ["scope", "value"]).select("path", "scope", "value", "n_records")


def generate_sequence(df: DataFrame, column: str, order: list[Column], *, start: int = 1) -> DataFrame:
    """Fill a null whole number with max + 1, + 2, ... (at least ``start``) in order.

    Rows are sorted in ranges and written once to the shared folder with their range and place in it;
    counts (one row for each range) and rows are both read from what was written, so range bounds
    are drawn only once and no task holds all rows. A range without a count is an error, never a lost row.
    """
    spark = df.sparkSession
    top = df.agg(F.max(column).alias("m")).first()["m"]
    first = start if top is None else max(start, int(top) + 1)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A stated number of ranges is never merged; ids within a task follow the order of its rows.
    ranged = df.where(F.col(column).isNull()).repartitionByRange(width, *order).sortWithinPartitions(*order)
    open_ = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "sequence")
    part, nth = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in open_.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, n = [], 0
    for p in sorted(counts):
        before.append((p, n))
        n += counts[p]
    offsets = spark.createDataFrame(before, "__part int, __before long")
    placed = open_.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    offset = F.coalesce("__before", F.raise_error(F.lit("a range of the sequence has no count")).cast("long"))
    filled = placed.withColumn(column, (F.lit(first) + offset + nth).cast("long")).select(*df.columns)
    return df.where(F.col(column).isNotNull()).unionByName(filled)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def derive_path(template: str, fields: dict[str, Column]) -> Column:
    """``{field}`` replaced by its value; null if one is null."""
    parts = [fields[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[^}]*\})", template) if p]
    return F.concat(*parts)


GENERATORS = {"uuid": F.uuid, "now": F.current_timestamp, "random": F.rand}


def backfill(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Nulls of the selected rows filled; values that are there stay."""
    pick = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({n: F.when(pick & F.col(n).isNull(), v).otherwise(F.col(n)) for n, v in values.items()})


def apply_batch(df: DataFrame, key: str, changes: DataFrame, *, atomic: bool = True, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A new table after a batch, and the changes that were refused.

    ``changes`` has ``op`` (create, update, delete) and the table's columns; a null ``if_revision`` or an equal one passes. Creating
    what exists, or changing what doesn't, is refused. An atomic batch with a refused change changes nothing.
    """
    revision = "revision" in df.columns and "if_revision" in changes.columns
    own = df.select(F.col(key).alias("__key"), *([F.col("revision").alias("__revision")] if revision else []))
    joined = changes.join(own, changes[key] == own["__key"], "left")
    exists = F.col("__key").isNotNull()
    bad = F.when((F.col("op") == "create") & exists, "already_exists").when((F.col("op") != "create") & ~exists, "not_found")
    if revision:
        bad = bad.when(F.col("if_revision").isNotNull() & (F.col("if_revision") != F.col("__revision")), "revision_conflict")
    if valid is not None:
        bad = bad.when((F.col("op") != "delete") & ~F.coalesce(valid, F.lit(False)), "invalid")
    judged = joined.withColumn("refused", bad).drop("__key", "__revision")
    refused = judged.where("refused is not null")
    if atomic and not refused.isEmpty():
        return df, refused
    good = judged.where("refused is null")
    rest = df.join(good.where("op <> 'create'").select(key), key, "left_anti")
    return rest.unionByName(good.where("op <> 'delete'").select(*df.columns)), refused
