"""Kinds of values, canonical JSON, emptiness and sort keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    """What is known of a value before the query runs."""

    name: str
    item: Kind | None = None
    fields: tuple[tuple[str, Kind], ...] = field(default=())

    @property
    def numeric(self) -> bool:
        return self.name in ("int", "float")

    def member(self, name: str) -> Kind | None:
        return dict(self.fields).get(name)


NULL, BOOL, INT, FLOAT, STRING = (Kind(n) for n in ("null", "bool", "int", "float", "string"))
DATE, TIMESTAMP, DURATION, DYNAMIC = (Kind(n) for n in ("date", "timestamp", "duration", "dynamic"))


def list_of(item: Kind) -> Kind:
    return Kind("list", item)


def kind_of(dtype: T.DataType) -> Kind:
    """The kind of a column's type."""
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, T.IntegralType):
        return INT
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, T.StringType):
        return STRING
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    if isinstance(dtype, T.ArrayType):
        return list_of(kind_of(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return Kind("map", fields=tuple((f.name, kind_of(f.dataType)) for f in dtype.fields))
    if isinstance(dtype, T.MapType):
        return Kind("map", kind_of(dtype.valueType))
    if isinstance(dtype, T.VariantType):
        return DYNAMIC
    return NULL


def canonical_json(value: Column, kind: Kind) -> Column:
    """The JSON text of a value, which is what groups are told apart by: 1 and 1.0 differ, null is a value."""
    if kind.name == "string":
        # to_json of an array quotes and escapes; the brackets go
        quoted = F.to_json(F.array(value))
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    elif kind.name in ("list", "map"):
        text = F.to_json(value)
    elif kind.name == "dynamic":
        text = F.to_json(value)
    elif kind.name == "duration":
        text = F.to_json(value)
    elif kind.name in ("date", "timestamp"):
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def is_empty(value: Column, kind: Kind, *, containers: bool = True) -> Column:
    """Null or "" and, with ``containers``, [] and {}; 0 and false are filled."""
    if kind.name == "string":
        return value.isNull() | (value == "")
    if kind.name == "dynamic":
        text = F.to_json(value)
        return value.isNull() | text.isin("null", '""', *(("[]", "{}") if containers else ()))
    if containers and kind.name == "list":
        return value.isNull() | (F.size(value) == 0)
    if containers and kind.name == "map" and kind.item is not None:
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def as_double(value: Column, kind: Kind) -> Column:
    """The number, or null for what is no number."""
    if kind.numeric:
        return value.cast("double")
    if kind.name == "dynamic":
        return F.when(dynamic_kind(value).isin("number"), F.try_variant_get(value, "$", "double"))
    return F.lit(None).cast("double")


def dynamic_kind(value: Column) -> Column:
    """JSON kind of a dynamic value: null, bool, number, string, list or map."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | name.isin("VOID"), "null")
        .when(name == "BOOLEAN", "bool")
        .when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "list")
        .when(name.startswith("OBJECT"), "map")
        .otherwise("number")
    )


def sort_keys(value: Column, kind: Kind, descending: bool) -> list[Column]:
    """Sort expressions: nulls last ascending and first descending; lists and maps by length.

    Dynamic values sort by number, then text, so that unlike kinds have a fixed order.
    """
    if kind.name in ("list", "map"):
        keys = [F.size(value) if kind.name == "list" or kind.item is not None else F.lit(len(kind.fields))]
        keys = [F.when(value.isNotNull(), k) for k in keys]
    elif kind.name == "dynamic":
        keys = [value.isNull() | (dynamic_kind(value) == "null"), as_double(value, kind), F.try_variant_get(value, "$", "string")]
        keys[0] = F.when(~keys[0], F.lit(1))
    else:
        keys = [value]
    return [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]
