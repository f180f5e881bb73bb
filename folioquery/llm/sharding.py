"""Balanced shards by vector bin packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise

#: A group with more than 1 / LARGE of a shard's bytes, tokens or rows is placed first; its rows are numbered, and if need be cut, in PARTS hashed parts.
LARGE, PARTS = 64, 64
#: Groups that one task places one after the other, and the most tasks.
PACKED, PACKERS = 4096, 4096


class Bins:
    """Shards with what is left of their capacity for bytes, tokens and rows, each as a share of the total to place."""

    def __init__(self, left: np.ndarray):
        self.left = left.copy()

    def place(self, unit: np.ndarray) -> int:
        """Put an item where the dot product with the residual capacity is highest.

        Ties go to the shard with the most bytes left, then to the smallest number.
        """
        score = self.left @ unit
        best = np.flatnonzero(score >= score.max() - 1e-12 * np.abs(score).max())
        shard = int(best[np.argmax(self.left[best, 0])])
        self.left[shard] -= unit
        return shard


def equal_bins(n_shards: int) -> Bins:
    return Bins(np.full((n_shards, 3), 1.0 / n_shards))


def largest_first(unit: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Order of placing: by an item's greatest share of a total, falling."""
    return np.lexsort((*ties[::-1], -unit.max(axis=1))) if len(unit) else np.zeros(0, dtype=np.int64)


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack_shards(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.005,
    parts: int = PARTS,
) -> DataFrame:
    """Assign every row to a shard so that bytes, tokens and rows are balanced.

    Rows of equal text form a group; the table is reduced to sizes and hashes
    once, and groups are summed before anything moves. Every group is an item of its own, placed
    whole, the largest first, where the dot product with the residual capacity is highest:
    the few groups that hold more than 1 / LARGE of a shard on the driver, all others in tasks of about PACKED
    groups, dealt by hash. Each task has the same share of every shard's residual and carries nothing but
    that residual from group to group.

    A group is cut into ``parts`` hashed parts only if shards can't be equal otherwise: while the large groups fill a shard beyond its
    share, or leave it room for bytes, tokens and rows so unlike that its bytes would end off the mean by more
    than half of ``tolerance`` (or of four rows of mean size, where that is more), the largest group of the worst
    such shard is cut, one at a time.

    Returns the id as ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``,
    ``n_tokens``, ``law`` ("bytes"), ``shard``, ``slot`` (gapless from 0 in each shard)
    and ``grown_shard`` (null).

    * null text: no bytes, size 1, in one group with the empty text.
    * null ids and repeated rows: every row gets a slot of its own.
    * empty table: empty result. Other columns of the input are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            count_tokens(text).alias("n_tokens"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit("group"), text).alias("g2"),
        ),
        "shard-sizes",
    )
    spark = docs.sparkSession
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = materialise(narrow.groupBy("g1", "g2").agg(*sums), "shard-groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "rows")], F.count(F.lit(1)).alias("n")).first()
    total = np.array([max(whole[c], 1) for c in ("bytes", "tokens", "rows")], dtype=np.float64)
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(("bytes", "tokens", "rows"), total, strict=True)])
    # At most 3 * LARGE * n_shards groups can each hold more than this of one of the three.
    is_large = share * (LARGE * n_shards) > 1
    large = materialise(groups.where(is_large).select("g1", "g2", F.lit(True).alias("is_large")), "shard-large-groups")
    part = F.pmod(F.xxhash64("doc_id", "g2"), F.lit(parts)).cast("int")
    keyed = narrow.join(F.broadcast(large), ["g1", "g2"], "left").withColumn("part", F.when(F.col("is_large"), part).otherwise(F.lit(-1))).drop("is_large")
    pieces = keyed.where("part >= 0").groupBy("g1", "g2", "part").agg(*sums).orderBy("g1", "g2", "part").collect()
    shard, left = _place_large(pieces, total, n_shards, max(tolerance, 4 * n_shards / max(whole["rows"], 1)))
    first = np.zeros(n_shards, dtype=np.int64)
    plan = []
    for p, s in zip(pieces, shard, strict=True):
        plan.append((p["g1"], p["g2"], p["part"], int(s), int(first[s])))
        first[s] += p["rows"]
    # Bounded by 3 * LARGE * n_shards * parts rows.
    at = "g1 long, g2 long, part int, shard int, first long"
    placed = _place_small(groups.where(~is_large).withColumn("share", share), total, whole["n"], left, first).unionByName(spark.createDataFrame(plan, at))
    # Rows and places meet on one key; a large group's rows are spread over its parts.
    key = ["g1", "g2", "part"]
    nth = F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        keyed.withColumn("nth", nth)
        .join(placed, key)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "n_tokens",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _place_large(pieces: list, total: np.ndarray, n_shards: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each part of the large groups, and what is left of the shards. Parts of a group stay together unless it is cut."""
    unit = np.array([(p["bytes"], p["tokens"], p["rows"]) for p in pieces], dtype=np.float64).reshape(-1, 3) / total
    group = np.cumsum([i > 0 and (p["g1"], p["g2"]) != (pieces[i - 1]["g1"], pieces[i - 1]["g2"]) for i, p in enumerate(pieces)])
    n_groups = int(group[-1]) + 1 if len(group) else 0
    cut = np.zeros(n_groups, dtype=bool)
    while True:
        # items: whole groups, and the parts of those that are cut
        item = np.where(cut[group], np.arange(len(unit)), len(unit) + group) if len(unit) else group
        names, item = np.unique(item, return_inverse=True)
        sums = np.zeros((len(names), 3))
        np.add.at(sums, item, unit)
        bins, where = equal_bins(n_shards), np.zeros(len(names), dtype=np.int64)
        for i in largest_first(sums, np.arange(len(sums))):
            where[i] = bins.place(sums[i])
        shard = where[item]
        # Small groups fill what is left evenly over the three; where a shard's residual leans, its bytes stay off the mean.
        rest = np.maximum(bins.left.sum(axis=0), 1e-12)
        lean = (bins.left / rest - (bins.left / rest).mean(axis=1, keepdims=True))[:, 0] * rest[0] * n_shards
        over = -bins.left.min(axis=1) * n_shards
        wrong = np.maximum(np.maximum(over, np.abs(lean)) - tolerance / 2, 0)
        for s in np.argsort(-wrong, kind="stable"):
            held = np.unique(group[(shard == s) & ~cut[group]]) if wrong[s] > 0 else []
            if len(held):
                size = np.zeros((n_groups, 3))
                np.add.at(size, group, unit)
                cut[held[np.argmax(size[held].max(axis=1))]] = True
                break
        else:
            return shard, bins.left


def _place_small(groups: DataFrame, total: np.ndarray, n_groups: int, left: np.ndarray, taken: np.ndarray) -> DataFrame:
    """``g1``, ``g2``, ``part`` (-1), ``shard`` and ``first`` (slot of the first row) of all other groups, placed in tasks."""
    spark, n_shards = groups.sparkSession, len(left)
    packers = max(1, min(PACKERS, -(-n_groups // PACKED)))
    own = groups.withColumn("packer", F.pmod(F.xxhash64("g2", "g1"), F.lit(packers)).cast("int"))
    sums = {r["packer"]: np.array([r["b"], r["t"], r["r"]]) / total for r in own.groupBy("packer").agg(F.sum("bytes").alias("b"), F.sum("tokens").alias("t"), F.sum("rows").alias("r")).collect()}
    # Every task has the share of each residual that its groups have of what is left to place.
    rest = np.maximum(left.sum(axis=0), 1e-12)
    start = {p: left * (v / rest) for p, v in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, before = None, None, None
        for batch in batches:
            packer = batch.column(0).to_numpy()
            values = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], axis=1)
            shards, firsts = np.zeros(len(packer), dtype=np.int32), np.zeros(len(packer), dtype=np.int64)
            for i, (p, v) in enumerate(zip(packer.tolist(), values, strict=True)):
                if p != now:
                    now, bins, before = p, Bins(start[p]), [0] * n_shards
                s = bins.place(v / total)
                shards[i], firsts[i] = s, before[s]
                before[s] += int(v[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array(shards), pa.array(firsts)], ["packer", "g1", "g2", "rows", "shard", "before"])

    dealt = own.repartition("packer").sortWithinPartitions("packer", F.desc("share"), "g1", "g2")
    packed = materialise(
        dealt.select("packer", "g1", "g2", "bytes", "tokens", "rows").mapInArrow(run, "packer int, g1 long, g2 long, rows long, shard int, before long"), "shard-placed"
    )
    counts = {(r["packer"], r["shard"]): r["n"] for r in packed.groupBy("packer", "shard").agg(F.sum("rows").alias("n")).collect()}
    bases, at = [], [int(t) for t in taken]
    for p in sorted(sums):
        for s in range(n_shards):
            bases.append((p, s, at[s]))
            at[s] += counts.get((p, s), 0)
    # Bounded by PACKERS * n_shards rows.
    base = spark.createDataFrame(bases, "packer int, shard int, base long")
    return packed.join(F.broadcast(base), ["packer", "shard"]).select("g1", "g2", F.lit(-1).alias("part"), "shard", (F.col("base") + F.col("before")).alias("first"))
