"""Links between records, as joins: extraction, resolution, traversal, backlinks, missing targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ways to find a target, in order; one with candidates decides, however it ends.
CLASSES = ("id", "basename", "title")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,}).*?(?:^ {0,3}\1[`~]*\s*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
_WIKI = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")
_TAG = re.compile(r"(?<![\w/#&])#([^\s#,.;:!?()\[\]{}'\"`<>|*=]+)")
_HEX = re.compile(r"(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})\Z")


def without_code(body: str) -> str:
    """The body with fenced and inline code blanked."""
    blank = lambda m: " " * len(m[0])
    return _CODE.sub(blank, _FENCE.sub(blank, body))


def markdown_links(text: str) -> Iterator[tuple[int, bool, str]]:
    """Place, embed mark and target of ``[text](target)``; brackets inside may nest."""
    at = 0
    while (start := text.find("[", at)) >= 0:
        at = start + 1
        if text.startswith("[[", start) or (start and text[start - 1] == "["):
            continue
        depth, i = 1, start + 1
        while i < len(text) and depth:
            depth += {"[": 1, "]": -1}.get(text[i], 0)
            i += 1
        if depth or i >= len(text) or text[i] != "(":
            continue
        depth, j = 1, i + 1
        while j < len(text) and depth and text[j] != "\n":
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        if depth:
            continue
        target = re.sub(r'\s+"[^"]*"$', "", text[i + 1 : j - 1].strip()).strip("<>")
        if target:
            yield start, start > 0 and text[start - 1] == "!", target


def extract(body: str) -> list[tuple[str, str]]:
    """Location (``body`` or ``embed``) and raw target of the links of a body, in order."""
    text = without_code(body or "")
    found = [(m.start(), bool(m[1]), f"[[{m[2]}]]") for m in _WIKI.finditer(text)]
    found += list(markdown_links(text))
    return [("embed" if e else "body", t) for _, e, t in sorted(found)]


def extract_tags(body: str) -> list[str]:
    """Tags of a body, each once: not in code, not a colour, not a number alone."""
    found = (m[1].rstrip("/-") for m in _TAG.finditer(without_code(body or "")))
    return list(dict.fromkeys(t for t in found if t and not _HEX.match(t) and not t.isdigit()))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("raw_target", T.StringType())])))
def body_links(body: pd.Series) -> pd.Series:
    return body.map(lambda b: [{"location": a, "raw_target": t} for a, t in extract(b)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def body_tags(body: pd.Series) -> pd.Series:
    return body.map(extract_tags)


def link_target(raw: Column) -> dict[str, Column]:
    """Parts of a link: its kind, its target without alias and anchor, and whether it is external.

    ``[[name]]`` is looked up by name; a bare text or the target of ``[text](target)`` is a path.
    """
    wiki = F.startswith(raw, F.lit("[[")) & F.endswith(raw, F.lit("]]"))
    inner = F.when(wiki, F.substring(raw, F.lit(3), F.length(raw) - 4)).otherwise(raw)
    md = F.regexp_extract(raw, r"^!?\[.*\]\((.*)\)$", 1)
    inner = F.when(md != "", md).otherwise(inner)
    target = F.trim(F.substring_index(F.substring_index(inner, "|", 1), "#", 1))
    external = F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    return {"kind": F.when(wiki, "wiki").otherwise("path"), "target": target, "external": external}


def normal_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and double slashes; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(acc.isNull(), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolution_keys(records: DataFrame) -> DataFrame:
    """``class``, ``key``, ``path`` for every way a record can be named. ``records`` has ``path``, ``id``, ``title`` (either may be null).

    A basename loses its .md; ids, basenames and titles compare in lower case.
    """
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    keys = F.array(
        F.struct(F.lit("id").alias("class"), F.lower("id").alias("key")),
        F.struct(F.lit("basename").alias("class"), F.lower(base).alias("key")),
        F.struct(F.lit("title").alias("class"), F.lower("title").alias("key")),
        F.struct(F.lit("path").alias("class"), F.col("path").alias("key")),
    )
    return records.select("path", F.explode(keys).alias("k")).where("k.key is not null").select("k.class", "k.key", "path")


def dealt(records: DataFrame) -> DataFrame:
    """The records in even parts, whatever the splits of their files: a task that groups texts sorts all rows that it reads."""
    return records.repartition(F.monotonically_increasing_id())


def resolve(links: DataFrame, records: DataFrame, *, unique: bool = False) -> DataFrame:
    """Resolve links to records with equi-joins and one ranked pick.

    ``links`` has ``source_path`` and ``raw_target``, and may have ``target_types``; ``records`` has ``path``, ``id``, ``title`` and may have ``types``.
    A name is looked up as id, then basename, then title: the first class with a candidate decides. Ids
    and titles must be alone in it, or the link is ambiguous; of basenames the
    nearest wins (same folder, fewer folders, path), unless ``unique``. A path
    is relative to the source's folder, absolute with a leading slash, and gets .md where needed.
    A path is never looked up elsewhere because of its type. Adds ``target_path`` and ``reason`` (null, ``missing``, ``ambiguous``, ``external``).

    Links are told apart by source and text. Without target types, names are ranked before
    links join them; with types, each link is ranked over the records of its name.
    """
    return _explain(links, pick(links, records, unique=unique))


def pick(links: DataFrame, records: DataFrame, *, unique: bool = False) -> DataFrame:
    """``resolve``, of those links alone that have a candidate: ``source_path``, ``raw_target``, ``target_path`` and ``why`` (null, ``missing``, ``ambiguous``)."""
    typed = "target_types" in links.columns and "types" in records.columns
    more = ["target_types"] if typed else []
    asked = links.select("source_path", "raw_target", *more).distinct()
    parts = link_target(F.col("raw_target"))
    asked = asked.select("*", *[c.alias(k) for k, c in parts.items()], _folder("source_path").alias("folder"))
    by_path = (F.col("kind") == "path") | F.contains("target", F.lit("/"))
    rooted = F.startswith("target", F.lit("/")) | ((F.col("kind") == "wiki") & ~F.startswith("target", F.lit(".")))
    whole = normal_path(F.when(rooted, F.col("target")).otherwise(F.concat_ws("/", "folder", "target")))
    asked = asked.withColumn("full", F.when(by_path & ~F.col("external"), whole))
    name = F.regexp_replace("target", r"\.md$", "")
    wanted = F.array(
        F.struct(F.lit("id").alias("class"), F.lower(name).alias("key")),
        F.struct(F.lit("basename").alias("class"), F.lower(name).alias("key")),
        F.struct(F.lit("title").alias("class"), F.lower(name).alias("key")),
    )
    paths = F.array(
        F.struct(F.lit("path").alias("class"), F.col("full").alias("key")),
        F.struct(F.lit("path").alias("class"), F.concat("full", F.lit(".md")).alias("key")),
    )
    looked = asked.where("not external").select("source_path", "raw_target", "folder", *more, F.explode(F.when(F.col("full").isNull(), wanted).otherwise(paths)).alias("w"))
    keys = resolution_keys(records)
    if not typed:
        return _pick_by_key(looked, keys, unique)
    keys = keys.join(records.select("path", "types"), "path")
    found = looked.join(keys, (F.col("w.class") == keys["class"]) & (F.col("w.key") == keys["key"]))
    order = F.array_position(F.array(*[F.lit(c) for c in ("path", *CLASSES)]), F.col("w.class"))
    eligible = F.col("target_types").isNull() | (F.size("target_types") == 0) | F.arrays_overlap("types", "target_types")
    rank = F.struct(
        (_folder("path") != F.col("folder")).alias("other_folder"), F.size(F.split("path", "/")).alias("depth"), F.col("path").alias("path")
    )
    exact = (F.col("w.key") == F.col("path")) & (F.col("w.class") == "path")
    found = found.select(
        "source_path", "raw_target", F.col("w.class").alias("class"), order.alias("order"), eligible.alias("ok"), "path",
        F.when(F.col("w.class") == "path", F.struct((~exact).alias("other_folder"), F.length("path").alias("depth"), F.col("path").alias("path"))).otherwise(rank).alias("rank"),
    )
    first = W.partitionBy("source_path", "raw_target")
    usable = (F.col("class") == "path") | F.col("ok")
    found = found.where(usable).withColumn("least", F.min("order").over(first)).where("order = least")
    picked = found.groupBy("source_path", "raw_target").agg(
        F.first("class").alias("class"), F.count_distinct("path").alias("n"), F.min("rank").alias("best"), F.min_by("ok", "rank").alias("ok")
    )
    alone = (F.col("n") == 1) | (F.col("class") == "path") | ((F.col("class") == "basename") & F.lit(not unique))
    return picked.select(
        "source_path", "raw_target", F.when(alone & F.col("ok"), F.col("best.path")).alias("target_path"),
        F.when(~alone, "ambiguous").when(~F.col("ok"), "missing").alias("why"),
    )


def _folder(path: str | Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def seat(path: Column) -> Column:
    """One source path for all of a folder: links lead to the same records from it as from ``path``."""
    folder = _folder(path)
    return F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))


def _pick_by_key(looked: DataFrame, keys: DataFrame, unique: bool) -> DataFrame:
    """The pick without types: each name's count and best record are found once, and links join those.

    A name that many records share and many links use is one row here, and one more for each
    folder that has it (class ``near``), so its links never meet its records pair by pair.
    """
    classes = ("path", "id", "near", "basename", "title")
    near = (F.col("class") == "basename") & F.lit(not unique)

    def placed(folder: Column) -> Column:
        anywhere = F.array(F.struct("class", F.lit("").alias("within")))
        return F.explode(F.when(near, F.concat(anywhere, F.array(F.struct(F.lit("near").alias("class"), folder.alias("within"))))).otherwise(anywhere))

    place = F.struct(F.size(F.split("path", "/")).alias("depth"), F.col("path").alias("path"))
    keys = keys.select("key", "path", placed(_folder("path")).alias("c")).select("c.class", "key", "c.within", "path")
    one = keys.groupBy("class", "key", "within").agg(F.min(place).alias("best"), F.max(place).alias("last"))
    asked = looked.select("source_path", "raw_target", "folder", "w.class", "w.key")
    asked = asked.select("source_path", "raw_target", "key", placed(F.col("folder")).alias("c")).select("source_path", "raw_target", "c.class", "key", "c.within")
    found = asked.join(one, ["class", "key", "within"])
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    alone = (F.col("best") == F.col("last")) | F.col("class").isin("path", "near") | near
    target = F.struct(F.when(alone, F.col("best.path")).alias("path"), alone.alias("alone"))
    picked = found.groupBy("source_path", "raw_target").agg(F.min_by(target, F.struct(order, F.length("key"))).alias("p"))
    return picked.select("source_path", "raw_target", F.col("p.path").alias("target_path"), F.when(~F.col("p.alone"), "ambiguous").alias("why"))


def _explain(links: DataFrame, picked: DataFrame) -> DataFrame:
    out = links.join(picked, ["source_path", "raw_target"], "left")
    external = link_target(F.col("raw_target"))["external"]
    reason = F.when(external, "external").when(F.col("target_path").isNotNull(), F.lit(None)).otherwise(F.coalesce("why", F.lit("missing")))
    return out.withColumn("reason", reason).drop("why")


def traverse(df: DataFrame, link: str, targets: DataFrame, key: str, prefix: str) -> DataFrame:
    """One static hop: each row with the columns of the record its link leads to, or nulls.

    Rows are neither lost nor multiplied: a key that several targets have leads to none of them.
    Counting keys deals and sorts targets as the join needs them. Hops chain, one call each.
    """
    at = f"{prefix}{key}"
    others = [c for c in targets.columns if c != key]
    named = targets.select(F.col(key).alias(at), F.struct(F.lit(True).alias("__there"), *others).alias("__record"))
    once = named.groupBy(at).agg(F.count(F.lit(1)).alias("__n"), F.any_value("__record").alias("__record")).where("__n = 1")
    once = once.select(at, *[F.col("__record")[c].alias(f"{prefix}{c}") for c in others])
    return df.join(once, df[link] == once[at], "left")


def follow_each(df: DataFrame, key: str, links: str, targets: DataFrame, target_key: str, value: str, out: str) -> DataFrame:
    """A list of links followed in place: explode, join, and collect by position; unresolved ones stay null."""
    each = df.select(key, F.posexplode(links).alias("__at", "__link"))
    found = each.join(targets.select(F.col(target_key).alias("__link"), F.col(value).alias("__value")), "__link", "left")
    lists = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__value"))), lambda x: x["__value"]).alias(out))
    return df.join(lists, key, "left")


def backlinks(edges: DataFrame) -> DataFrame:
    """``target_path`` with its sorted distinct sources and their number."""
    once = edges.where("target_path is not null").select("source_path", "target_path").distinct()
    return once.groupBy("target_path").agg(F.sort_array(F.collect_list("source_path")).alias("sources"), F.count(F.lit(1)).alias("n_sources"))


def broken(df: DataFrame, link: Column, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose link, if they have one, leads to no record."""
    known = targets.select(F.col(key).alias("__known")).distinct()
    return df.where(link.isNotNull()).join(known, link == F.col("__known"), "left_anti")


def rename_references(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """New texts of links whose target was renamed: alias and anchor are kept. ``renames`` has ``old_path`` and ``new_path``."""
    hit = edges.join(renames, edges["target_path"] == renames["old_path"])
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    base = lambda c: F.substring_index(stem(c), "/", -1)
    tail = F.regexp_extract("raw_target", r"^\[\[[^#|\]]*([#|][^\]]*)?\]\]$", 1)
    named = F.when(F.contains("raw_target", F.lit("/")), stem(F.col("new_path"))).otherwise(base(F.col("new_path")))
    wiki = F.concat(F.lit("[["), named, tail, F.lit("]]"))
    return hit.select(
        "source_path", "raw_target", "new_path", F.when(F.startswith("raw_target", F.lit("[[")), wiki).otherwise(F.col("new_path")).alias("new_target")
    )
