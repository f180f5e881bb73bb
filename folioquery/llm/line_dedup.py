"""Removal of lines that many documents repeat."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import ASCII_SPACE, materialise

_ID, _TEXT, _SUM, _DROP = "__fq_id", "__fq_text", "__fq_sum", "__fq_drop"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case.

    ``lower`` is the fast way for pure ASCII; other lines go through a table so
    that only A-Z change.
    """
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """Drop lines whose key stands in ``min_docs`` documents or more.

    Lines are exploded with their positions and hashed (two XXH64 of different
    seeds, 128 bits); each hash counts its distinct documents; the lines of a
    hash over the threshold are dropped everywhere but in the largest id that
    holds it, and every text is put together again from the positions that stay.

    Only hashes and positions travel to the count. The repeated hashes are
    written to the shared folder first, so the join back reads two plain
    tables and Spark can split a hash that a third of all lines share.

    Returns the input's columns with ``text_col`` replaced, and ``n_lines`` and
    ``n_dropped`` (a clashing input column of that name is replaced).

    * null or empty text: one empty line, which stays.
    * null id: such rows count for no document and never hold the kept copy.
    * repeated rows and rows that share an id: one document for the count; each
      row is rebuilt from its own text.
    * a text all of whose lines go: the empty text.
    * empty table: empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.select(F.col(id_col).alias(_ID), text.alias(_TEXT))
        .select(_ID, F.xxhash64(_TEXT).alias(_SUM), F.posexplode(F.split(_TEXT, "\n", -1)).alias("pos", "line"))
        .select(_ID, _SUM, "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(_ID, _SUM, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    repeated = materialise(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct(_ID).alias("n"), F.max(_ID).alias("keep"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keep"),
        "repeated-lines",
    )
    dropped = (
        lines.join(repeated, ["h1", "h2"])
        .where(~F.col(_ID).eqNullSafe(F.col("keep")))
        .groupBy(F.col(_ID).alias("drop_id"), F.col(_SUM).alias("drop_sum"))
        .agg(F.sort_array(F.collect_set("pos")).alias(_DROP))
    )
    rows = docs.withColumn(_SUM, F.xxhash64(text))
    split = F.split(text, "\n", -1)
    n_lines = F.size(split)
    n_dropped = F.coalesce(F.size(_DROP), F.lit(0))
    kept = F.when(n_dropped == 0, text).otherwise(
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(_DROP)), lambda i: F.get(split, i)
            ),
            "\n",
        )
    )
    joined = rows.join(
        dropped.hint("shuffle_hash"),
        rows[id_col].eqNullSafe(dropped["drop_id"]) & (rows[_SUM] == dropped["drop_sum"]),
        "left",
    )
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    values = {c: rows[c] for c in others} | {text_col: kept}
    return joined.select(
        *[values[c].alias(c) for c in docs.columns if c in values],
        n_lines.cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )
