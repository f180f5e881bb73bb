"""Exact top-k search over integer vectors with MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise
from folioquery.llm.vectors import by_block, components_of, merge_best, usable

#: Vectors of one shard: the fewest and the most; more than SHARDS shards are made only of the largest.
SHARD, LARGEST, SHARDS = 4096, 65_536, 64
#: Terms that are probed between two prunings.
PROBE = 4


class Shard:
    """Postings of a shard: for every term (dimension) the values of all vectors, with the bounds of the term.

    A query's component times the term's smallest and largest value bounds what the term can
    add. All is counted from the least that each term can add, so a term's bound is the width of that range.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(values[order].T)
        self.high, self.low = self.postings.max(axis=1), self.postings.min(axis=1)
        # With repeated ids, as many more vectors are kept as one id can hide.
        self.repeat = int(np.unique(self.ids, return_counts=True)[1].max())
        #: Terms traversed, terms in all, vectors probed and vectors in all, over the queries so far.
        self.work = np.zeros(4, dtype=np.int64)

    def essential(self, least: np.ndarray, rest: np.ndarray, theta: float) -> int:
        """How many terms are essential: the shortest prefix without which nothing reaches the threshold.

        A vector with the least value on all terms of the prefix has at most their least sum and the rest's bound.
        """
        bound = np.concatenate([[0.0], np.cumsum(least)]) + rest
        short = np.flatnonzero(bound < theta)
        return int(short[0]) if len(short) else len(least)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best (ids, scores) of the shard, ties to the smaller id; never the query itself."""
        a, b = q * self.high, q * self.low
        most, least = np.maximum(a, b), np.minimum(a, b)
        terms = np.argsort(-(most - least), kind="stable")
        most, least, q, n = most[terms], least[terms], q[terms], len(terms)
        # rest[m]: the most that the terms after the first m can add
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])
        k, wanted = k * self.repeat, k
        others = np.flatnonzero(self.ids != query_id)
        theta = -np.inf
        if len(others) > k:
            # A first threshold, reached by the vectors that are best on the strongest terms.
            head = np.zeros(len(self.ids))
            self._traverse(head, q, terms, 0, min(PROBE, n))
            theta = self._reached(q, terms, others[np.argpartition(-head[others], k - 1)[:k]])
        m = self.essential(least, rest, theta)
        part = np.zeros(len(self.ids))
        self._traverse(part, q, terms, 0, m)
        if len(others) > k:
            theta = max(theta, self._reached(q, terms, others[np.argpartition(-part[others], k - 1)[:k]]))
        alive = others[part[others] + rest[m] >= theta]
        self.work += (m, n, len(alive), len(others))
        # The other terms are probed only while vectors can still compete: in whole postings
        # as long as most vectors do, then one by one.
        while m < n and len(alive) * 4 > len(part):
            to = min(n, m + PROBE)
            self._traverse(part, q, terms, m, to)
            m = to
            alive = alive[part[alive] + rest[m] >= theta]
        part = part[alive]
        while m < n and len(alive):
            to = min(n, m + PROBE)
            part = part + q[m:to] @ self.postings[np.ix_(terms[m:to], alive)]
            m = to
            keep = part + rest[m] >= theta
            alive, part = alive[keep], part[keep]
        top = np.lexsort((self.ids[alive], -part))[:k]
        if self.repeat > 1:
            top = top[np.sort(np.unique(self.ids[alive][top], return_index=True)[1])][:wanted]
        return self.ids[alive][top], part[top].astype(np.int64)

    def _traverse(self, part: np.ndarray, q: np.ndarray, terms: np.ndarray, start: int, stop: int) -> None:
        """Add the postings of some terms to the partial scores of all vectors."""
        for t in range(start, stop):
            part += q[t] * self.postings[terms[t]]

    def _reached(self, q: np.ndarray, terms: np.ndarray, some: np.ndarray) -> float:
        """The least whole score of some vectors."""
        return float((q @ self.postings[np.ix_(terms, some)]).min())


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest integer inner products of every query with all other rows, exactly.

    Components become floor(scale * x). Rows are dealt by hash into shards of
    SHARD to LARGEST vectors; every query meets every shard. In a shard the query's terms
    are split by their score bounds: the essential ones, without which no vector reaches the
    threshold, are traversed for all vectors, the others are probed only while a vector can still
    reach it. The shards' results are merged by query.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; fewer than ``k`` rows where fewer candidates exist.

    * null vectors and vectors with null or non-finite components take no part, as query or candidate; nor do null ids.
    * vectors of different length: missing components are zero.
    * rows that repeat an id: the best of them counts once. Ties go to the smaller id.
    * scores are exact up to 2^53. Empty table: empty result. Other columns are not read.
    """
    clean = materialise(
        vectors.where(usable(F.col(vector_col), zero=True) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("vec_id"),
            components_of(vectors, vector_col).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ),
        "search-vectors",
    )
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    shards, dim = max(1, -(-size["n"] // min(LARGEST, max(SHARD, size["n"] // SHARDS)))), size["dim"] or 0
    rows = clean.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v", F.lit(0).alias("at"))
    asked = clean.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v", F.lit(0).alias("at"))

    def searcher(ids: np.ndarray, v: np.ndarray, _: np.ndarray):
        shard = Shard(ids, np.floor(scale * v))

        def search(query_ids: np.ndarray, q: np.ndarray, _: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, one in zip(query_ids, np.floor(scale * q), strict=True):
                yield shard.best(i, one, k)

        return search

    return merge_best(by_block(rows.unionByName(asked), ["shard"], dim, searcher, "long"), k, "long")
