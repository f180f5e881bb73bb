"""Collections of Markdown files with YAML front matter."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators.frame import Records, path_facts
from folioquery.operators.links import extract, extract_tags
from folioquery.operators.types import glob_regex
from folioquery.plans.compiler import Val
from folioquery.values import BOOL, DYNAMIC, FLOAT, INT, STRING, Kind, list_of

SCHEMA = (
    "path string, revision string, size long, mtime string, invalid_reason string, raw_json string, body string, "
    "tags array<string>, links array<string>, embeds array<string>"
)
#: Declared field types and the kinds their columns have.
FIELD_KINDS: dict[str, tuple[Kind, str]] = {
    "string": (STRING, "string"), "enum": (STRING, "string"), "link": (STRING, "string"), "time": (STRING, "string"),
    "date": (STRING, "string"), "datetime": (STRING, "string"), "integer": (INT, "bigint"), "number": (FLOAT, "double"),
    "boolean": (BOOL, "boolean"), "list": (list_of(STRING), "array<string>"),
}


def _plain(x: object) -> object:
    """YAML values as JSON ones: keys that are no text are dropped, infinities become text, dates ISO text."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if isinstance(k, str)}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return ".nan" if math.isnan(x) else ".inf" if x > 0 else "-.inf"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return x if isinstance(x, (str, int, float, bool)) or x is None else str(x)


def parse(content: bytes, *, whole: bool = False) -> tuple[str | None, str | None, str | None]:
    """Reason it is invalid (or none), front matter as JSON, and body. ``whole``: the file is all YAML."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "invalid_utf8", None, None
    head, body = None, text
    if whole:
        head, body = text, ""
    else:
        lines = text.splitlines(keepends=True)
        if lines and lines[0].rstrip() == "---":
            for i, line in enumerate(lines[1:], 1):
                if line.rstrip() == "---":
                    head, body = "".join(lines[1:i]), "".join(lines[i + 1 :])
                    break
    if head is None:
        return None, "{}", body
    try:
        value = yaml.safe_load(head)
    except (yaml.YAMLError, ValueError):
        return "invalid_yaml", None, None
    if value is None:
        value = {}
    if not isinstance(value, dict):
        return "non_mapping_frontmatter", None, None
    return None, json.dumps(_plain(value), ensure_ascii=False), body


def read_collection(
    spark: SparkSession, root: str, *, extensions: tuple[str, ...] = ("md",), exclude: tuple[str, ...] = (), config_file: str = "collection.yaml"
) -> DataFrame:
    """All records below ``root``, with files that can't be read as rows with an ``invalid_reason``.

    Hidden parts, ``node_modules`` and excluded globs are left out, and so is every
    nested collection: a folder below the root that has a config file of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + _quote(base.split("://")[-1]) + "/", "")
    files = files.withColumn("rel", rel)
    listed = files.select("rel")
    fences = listed.where(F.endswith("rel", F.lit(f"/{config_file}"))).select(F.substring("rel", F.lit(1), F.length("rel") - len(config_file) - 1).alias("fence"))
    kept = files.where(~F.rlike("rel", F.lit(r"(^|/)(\.[^/]*|node_modules)(/|$)")))
    kept = kept.where(F.lower(F.substring_index("rel", ".", -1)).isin(*[e.lower() for e in extensions], "base"))
    for g in exclude:
        kept = kept.where(~F.rlike("rel", F.lit(glob_regex(g))))
    # every ancestor folder is a key, so the fence is an equi-join
    parents = kept.select("rel", F.posexplode(F.split("rel", "/")).alias("n", "part")).where("n > 0")
    inside = parents.select("rel", F.expr("substring_index(rel, '/', n)").alias("fence")).join(fences, "fence", "left_semi").select("rel").distinct()
    kept = kept.join(inside, "rel", "left_anti")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rev, size, mtime, content in batch.itertuples(index=False):
                reason, raw, body = parse(content, whole=path.endswith(".base"))
                fields = json.loads(raw) if raw else {}
                listed = fields.get("tags") if isinstance(fields.get("tags"), list) else []
                found = extract(body or "")
                tags = list(dict.fromkeys([str(t).lstrip("#") for t in listed] + extract_tags(body or "")))
                out.append((path, rev, size, mtime, reason, raw, body, tags, [t for k, t in found if k == "body"], [t for k, t in found if k == "embed"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    revision = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return kept.select("rel", revision.alias("revision"), F.col("length").alias("size"), stamp.alias("mtime"), "content").mapInPandas(load, SCHEMA)


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def collection_records(df: DataFrame, fields: dict[str, str] | None = None, type_keys: tuple[str, ...] = ("type", "types")) -> Records:
    """Records of a collection. ``fields`` gives declared types; other keys are read as dynamic values by name."""
    raw = F.try_parse_json(F.col("raw_json"))
    out: dict[str, Val] = {}
    for name, declared in (fields or {}).items():
        at = f"$.{name}"
        if declared not in FIELD_KINDS:
            out[name] = Val(F.try_variant_get(raw, at, "variant"), DYNAMIC)
            continue
        kind, sql = FIELD_KINDS[declared]
        v = F.try_variant_get(raw, at, "variant")
        shape = F.schema_of_variant(v)
        fits = {"bigint": ~shape.isin("STRING", "BOOLEAN"), "double": ~shape.isin("STRING", "BOOLEAN"), "boolean": shape == "BOOLEAN"}.get(sql, F.lit(True))
        out[name] = Val(F.when(fits, F.try_variant_get(raw, at, sql)), kind)
    stated = F.array(*[F.try_variant_get(raw, f"$.{k}", "string") for k in type_keys[:1]])
    more = [F.coalesce(F.try_variant_get(raw, f"$.{k}", "array<string>"), F.array().cast("array<string>")) for k in type_keys]
    types = F.array_distinct(F.filter(F.concat(stated, *more), lambda t: t.isNotNull() & ~F.startswith(t, F.lit("["))))
    path = F.col("path")
    file = {**path_facts(path), **{k: Val(F.col(k), kind) for k, kind in {"size": INT, "mtime": STRING, "body": STRING}.items()}}
    file |= {k: Val(F.col(k), list_of(STRING)) for k in ("tags", "links", "embeds")}
    return Records(df, path, out, out, types, file, invalid=F.col("invalid_reason"))


def key_present(name: str):
    """Whether a key is written in the front matter, also with null."""
    return F.coalesce(F.array_contains(F.json_object_keys("raw_json"), name), F.lit(False))


def serialize(front: dict, body: str) -> str:
    """A file from front matter and body; keys stay in order."""
    if not front:
        return body
    return "---\n" + yaml.safe_dump(front, sort_keys=False, allow_unicode=True) + "---\n" + body


def write_collection(df: DataFrame, root: str) -> None:
    """Write ``path``, ``raw_json``, ``body`` rows as files below ``root``, one task per partition.

    The root must be a path that every executor can write, such as a mounted store.
    """

    def put(rows: Iterator) -> None:
        from pathlib import Path

        for r in rows:
            target = Path(root, r["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(serialize(json.loads(r["raw_json"] or "{}"), r["body"] or ""), encoding="utf-8")

    df.select("path", "raw_json", "body").foreachPartition(put)
