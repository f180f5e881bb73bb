"""Bounded samples of labelled documents, and folds by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_class: int) -> DataFrame:
    """``doc_id``, ``text``, ``label``, ``lang`` of at most ``per_class`` documents of each class.

    Only labels outside the held-out fold are read. Documents are drawn in
    order of a hash of their id, so the sample is the same on every run. Written
    to the shared folder.

    * labels that are null or neither 0 nor 1, and labels of null ids: left out.
    * an id with both labels: left out; repeated equal labels: one.
    * several documents with one id: the one whose text has the smallest hash. Null texts: empty.
    """
    clear = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
        .select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("draw"))
    )
    drawn = None
    for y in (0, 1):
        part = clear.where(F.col("label") == y).orderBy("draw", "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    # The drawn ids are at most 2 * per_class rows.
    found = texts.join(F.broadcast(drawn.select("doc_id", "label", "draw")), "doc_id")
    one = found.groupBy("doc_id", "label", "draw").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("t"))
    return materialise(one.select("doc_id", "t.text", "label", "t.lang", "draw"), f"labelled-{label}")
