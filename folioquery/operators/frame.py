"""Record frames: a DataFrame and what its columns mean."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.plans.compiler import Val
from folioquery.values import BOOL, INT, STRING, Kind, kind_of, list_of

#: Facts of a record's file, with their kinds.
FILE_FACTS = {
    "path": STRING, "name": STRING, "basename": STRING, "ext": STRING, "folder": STRING, "size": INT, "mtime": STRING,
    "ctime": STRING, "body": STRING, "tags": list_of(STRING), "links": list_of(STRING), "embeds": list_of(STRING), "backlinks": list_of(STRING),
}


@dataclass(frozen=True)
class Records:
    """A lazy set of records.

    ``fields`` are the effective values by name, ``raw`` the stored ones. Typed tables keep
    their own columns, so filters and column choice reach the scan.
    """

    df: DataFrame
    path: Column
    fields: Mapping[str, Val]
    raw: Mapping[str, Val]
    types: Column
    file: Mapping[str, Val] = field(default_factory=dict)
    invalid: Column | None = None
    #: The types of every record, where all have the same.
    fixed_types: tuple[str, ...] | None = None

    def has_type(self, names: list[str]) -> Column:
        """Any of the types, whatever the case of A-Z."""
        wanted = [n.lower() for n in names]
        if self.fixed_types is not None:
            return F.lit(any(t.lower() in wanted for t in self.fixed_types))
        return F.exists(self.types, lambda t: F.lower(t).isin(wanted))

    def with_fields(self, **more: Val) -> Records:
        return replace(self, fields={**self.fields, **more})

    def bindings(self) -> dict[str, object]:
        """The fixed names of the canonical dialect."""
        facts = {"path": Val(self.path, STRING), **self.file}
        return {
            "record": dict(self.fields),
            "raw": dict(self.raw),
            "note": dict(self.raw),
            "file": facts,
            "types": Val(self.types, list_of(STRING)),
        }


def path_facts(path: Column) -> dict[str, Val]:
    """Name, folder and the like, from a path alone."""
    name = F.substring_index(path, "/", -1)
    dotted = F.contains(name, F.lit("."))
    ext = F.when(dotted, F.substring_index(name, ".", -1)).otherwise("")
    stem = F.when(dotted, F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)
    folder = F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)).otherwise("")
    return {k: Val(c, STRING) for k, c in {"name": name, "basename": stem, "ext": ext, "folder": folder}.items()}


def from_table(df: DataFrame, type_name: str, *key: str) -> Records:
    """A typed table as records: path ``type/key``, one type, fields as they are."""
    fields = {f.name: Val(F.col(f.name), kind_of(f.dataType)) for f in df.schema.fields}
    path = F.concat_ws("/", F.lit(type_name), *[F.col(k).cast("string") for k in key])
    return Records(df, path, fields, fields, F.array(F.lit(type_name)), path_facts(path), fixed_types=(type_name,))


def val(col: Column, kind: Kind = BOOL) -> Val:
    return Val(col, kind)
