"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise
from folioquery.llm.vectors import PARTIAL, by_block, components_of, matrix, merge_best, usable

#: Projected dimensions and bits of each on a curve; the most curves, and the fewest.
AXES, BITS, CURVES, FEWEST = 10, 4, 8, 2
#: Places of a curve that one task searches: twice a window, within these bounds.
BLOCK = (512, 8192)
#: Documented samples: rows on which the grids are fitted, and rows whose nearest are found exactly to fit the windows.
SAMPLE, PROBES = 4096, 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (one row each, ``bits`` bits a coordinate, at most 62 in all).

    The transposed form is found by undoing the rotations bit by bit, then Gray coded.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= np.where(on, 0, swap) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


@dataclass
class Curves:
    """Projections and shifted grids of the curves."""

    axes: np.ndarray  # curve, dimension, axis
    grid: list[list[np.ndarray]]  # curve, axis: bounds of the cells

    def keys(self, v: np.ndarray, curve: int) -> np.ndarray:
        y = v @ self.axes[curve]
        cells = np.stack([np.searchsorted(g, y[:, a], side="right") for a, g in enumerate(self.grid[curve])], axis=1)
        return hilbert_keys(cells, BITS)


@dataclass(frozen=True)
class Windows:
    """How many curves are searched, and how many places before and after a query's own on each."""

    curves: int
    reach: int

    def share(self, n: int) -> float:
        """The part of a table of ``n`` rows that a query is compared with; a row in several windows counts for each."""
        return self.curves * min(n, 2 * self.reach + 1) / max(n, 1)


def fit_curves(v: np.ndarray, seed: int) -> Curves:
    """Random projections, and grids at shifted quantiles of a sample's."""
    rng = np.random.default_rng(seed)
    dim, cells = v.shape[1], 1 << BITS
    n_axes = min(AXES, dim)
    axes, grid = [], []
    for _ in range(CURVES):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :n_axes]
        y = v @ turn
        shift = rng.uniform(-0.5, 0.5, n_axes) / cells
        axes.append(turn)
        grid.append([np.quantile(y[:, a], np.clip(np.arange(1, cells) / cells + shift[a], 0, 1)) for a in range(n_axes)])
    return Curves(np.array(axes), grid)


def fit_windows(gaps: np.ndarray, n: int, k: int, target: float) -> Windows:
    """The number of curves and the reach with the least work that hold the target share of neighbours.

    ``gaps`` has, for each curve, the places between probes and their nearest rows in the whole table.
    """
    if not gaps.size:
        return Windows(FEWEST, min(n, k))
    reach = [max(k, int(np.ceil(np.quantile(gaps[:c].min(axis=0), target)))) for c in range(FEWEST, len(gaps) + 1)]
    return min((Windows(c, min(r, n)) for c, r in enumerate(reach, FEWEST)), key=lambda w: (w.share(n), w.curves))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    *,
    target: float = 0.95,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows nearest to each query by inner product, found in windows of several Hilbert curves.

    Each curve orders all vectors by the Hilbert key of a random projection on a shifted
    grid. The orders are sorted in ranges and written once, with every row's place. A query is compared with
    the rows a fixed number of places before and after its own on each curve, block by block in separate tasks; the
    windows' best are merged and ranked on the original vectors.

    Grids are fitted on at most SAMPLE rows, those of the smallest id hash; every row is indexed. The windows are fitted to
    the table as it is: the nearest of PROBES rows are found exactly, in one pass over all rows, and the windows are the
    smallest that hold the ``target`` share of them. So they follow the data, not its size: where vectors are spread evenly in all
    directions no order keeps neighbours together, and windows cover most of the table.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double).

    * vectors that are null, zero or hold a null or non-finite component take no part; nor do null ids.
    * vectors of different length: missing components are zero.
    * rows that repeat an id: the best of them counts once. Ties go to the smaller id.
    * many equal vectors: their key is told apart by a hash of the id, so they lie on different places.
    * windows reach at least ``k`` places, so every query has ``k`` candidates where the table has.
    * empty table: empty result. Other columns are not read.
    """
    clean = materialise(
        vectors.where(usable(F.col(vector_col), zero=False) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("vec_id"),
            components_of(vectors, vector_col).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
            F.xxhash64(id_col).alias("tie"),
        ),
        "curve-vectors",
    )
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    if not n:
        return clean.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = clean.orderBy("tie", "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    v = matrix(sample.column("v").chunk(0), dim)
    placed = order_by_curves(clean, fit_curves(v, seed), n, dim)
    windows = measured_windows(clean, placed, sample.column("vec_id").to_numpy()[:PROBES], v[:PROBES], n, dim, k, target)
    return search_windows(placed, windows, n, dim, k)


def order_by_curves(clean: DataFrame, curves: Curves, n: int, dim: int) -> DataFrame:
    """``curve``, ``at`` (the row's place on it, from 0), ``vec_id``, ``v`` and ``asks`` of every row on every curve."""
    spark = clean.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1), dim)
            for c in range(len(curves.axes)):
                key = pa.array(curves.keys(v, c), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), key, *batch.columns], ["curve", "key", "vec_id", "v", "asks", "tie"])

    kind = clean.schema["v"].dataType.simpleString()
    keyed = clean.mapInArrow(place, f"curve int, key long, vec_id long, v {kind}, asks boolean, tie long")
    order = ["curve", "key", "tie", "vec_id"]
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written with its range and its place there, so that counts and rows tell of one and the same order.
    ranged = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order)
    ordered = materialise(ranged.select("curve", "vec_id", "v", "asks", F.monotonically_increasing_id().alias("row")), "curve-order")
    part, nth = F.shiftright("row", 33).cast("int"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist()
    offsets = spark.createDataFrame(list(zip(sorted(counts), before, strict=False)), "part int, before long")
    # Each curve holds all n rows, one curve after the other.
    at = F.col("before") + nth - F.col("curve").cast("long") * n
    return ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("curve", at.alias("at"), "vec_id", "v", "asks")


def measured_windows(clean: DataFrame, placed: DataFrame, ids: np.ndarray, probes: np.ndarray, n: int, dim: int, k: int, target: float) -> Windows:
    """Windows that hold the target share of the exact ``k`` nearest of the probes, found in one pass over all rows."""
    spark = clean.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            there = batch.column(0).to_numpy()
            for at in range(0, len(there), 4096):
                some = np.broadcast_to(there[at : at + 4096], (len(ids), len(there[at : at + 4096])))
                score = probes @ matrix(batch.column(1).slice(at, 4096), dim).T
                score[some == ids[:, None]] = -np.inf
                own, best = np.concatenate([own, some], axis=1), np.concatenate([best, score], axis=1)
                if best.shape[1] > k:
                    keep = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    own, best = np.take_along_axis(own, keep, axis=1), np.take_along_axis(best, keep, axis=1)
        live = best > -np.inf
        rows = [(o[m].tolist(), b[m].tolist()) for o, b, m in zip(own, best, live, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["query_id", "ids", "scores"]
        )

    partial = clean.select("vec_id", "v").mapInArrow(scan, PARTIAL.format("double"))
    pairs = [(r["query_id"], r["vec_id"]) for r in merge_best(partial, k, "double").select("query_id", "vec_id").collect()]  # at most PROBES * k
    wanted = spark.createDataFrame([(int(i),) for i in {*ids.tolist(), *(b for _, b in pairs)}], "vec_id long")
    # Of rows that repeat an id, one place stands for all.
    found = placed.join(F.broadcast(wanted), "vec_id").groupBy("curve", "vec_id").agg(F.min("at").alias("at"))
    places = {(r["curve"], r["vec_id"]): r["at"] for r in found.collect()}
    gaps = [[abs(places[c, a] - places[c, b]) for a, b in pairs] for c in range(CURVES)]
    return fit_windows(np.array(gaps, dtype=np.int64).reshape(CURVES, -1), n, k, target)


def search_windows(placed: DataFrame, windows: Windows, n: int, dim: int, k: int) -> DataFrame:
    """The ``k`` best of every query in its windows, merged."""
    reach = windows.reach
    placed = placed.where(F.col("curve") < windows.curves)
    block = min(max(2 * reach, BLOCK[0]), BLOCK[1])
    rows = placed.select("curve", F.floor(F.col("at") / block).alias("block"), F.lit(False).alias("is_query"), "vec_id", "v", "at")
    low, high = F.greatest(F.col("at") - reach, F.lit(0)), F.least(F.col("at") + reach, F.lit(n - 1))
    around = F.sequence(F.floor(low / block), F.floor(high / block))
    asked = placed.where("asks").select("curve", F.explode(around).alias("block"), F.lit(True).alias("is_query"), "vec_id", "v", "at")

    def searcher(ids: np.ndarray, v: np.ndarray, places: np.ndarray):
        order = np.argsort(places, kind="stable")
        ids, v, places = ids[order], np.ascontiguousarray(v[order]), places[order]
        kept = k * int(np.unique(ids, return_counts=True)[1].max())  # repeated ids hide no others

        def search(query_ids: np.ndarray, q: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            first, stop = np.searchsorted(places, own - reach), np.searchsorted(places, own + reach, side="right")
            for at in range(0, len(q), 512):
                rough = q[at : at + 512] @ v.T
                for i, (a, b) in enumerate(zip(first[at : at + 512], stop[at : at + 512], strict=True)):
                    one = rough[i, a:b]
                    one[ids[a:b] == query_ids[at + i]] = -np.inf
                    kth = np.partition(one, len(one) - kept)[len(one) - kept] if len(one) > kept else -np.inf
                    near = a + np.flatnonzero((one >= kth - 1e-9 * (1 + abs(kth))) & (one > -np.inf) if kth > -np.inf else one > -np.inf)
                    # One order of summation wherever a pair is met.
                    exact = (v[near] * q[at + i]).sum(axis=1)
                    top = np.lexsort((ids[near], -exact))
                    top = top[np.sort(np.unique(ids[near][top], return_index=True)[1])][:k]
                    yield ids[near][top], exact[top]

        return search

    return merge_best(by_block(rows.unionByName(asked), ["curve", "block"], dim, searcher, "double"), k, "double")
