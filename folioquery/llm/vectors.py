"""What the vector searches share: valid vectors, blocks as matrices, and the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: Column, *, zero: bool) -> Column:
    """True for a vector without null or non-finite components; with ``zero`` false, also not all zero."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = vector.isNotNull() & F.coalesce(finite, F.lit(False))
    return ok if zero else ok & F.exists(x, lambda v: v != 0)


def components_of(df: DataFrame, name: str) -> Column:
    """A vector column as floats where it has them, else as doubles: what is exact, and no wider than it was."""
    item = df.schema[name].dataType.elementType
    return F.col(name) if isinstance(item, T.FloatType | T.DoubleType) else F.col(name).cast("array<double>")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; a shorter list is filled with zeros."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(length) and (length == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(length), dim))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


#: A partial result: the best ids of one block for a query, best first.
PARTIAL = "query_id long, ids array<long>, scores array<{}>"


def by_block(rows: DataFrame, keys: list[str], dim: int, searcher: Callable[[np.ndarray, np.ndarray, np.ndarray], Callable], score: str) -> DataFrame:
    """Search every block. ``rows`` has the block's ``keys``, ``is_query``, ``vec_id``, ``v`` and ``at`` (a place that the search may use).

    A block's candidates come first and are held; its queries then stream past in
    batches, so memory depends on neither the number of queries nor of blocks.
    ``searcher(ids, vectors, places)`` prepares a block and returns a function from
    (query ids, query vectors, places) to one (ids, scores) for each query.
    """
    n = len(keys)
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        places: list[np.ndarray] = []
        search = None
        for batch in batches:
            head = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 2)]
            v, at = matrix(batch.column(n + 2), dim), batch.column(n + 3).to_numpy()
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in head[: n + 1]], axis=0)) + 1
            for a, b in zip([0, *new], [*new, len(v)], strict=True):
                if a == b:
                    continue
                now = tuple(c[a] for c in head[:n])
                if now != key:
                    key, ids, vectors, places, search = now, [], [], [], None
                if not head[n][a]:
                    ids.append(head[n + 1][a:b])
                    vectors.append(v[a:b])
                    places.append(at[a:b])
                    continue
                if not ids:
                    continue
                if search is None:
                    search = searcher(np.concatenate(ids), np.concatenate(vectors), np.concatenate(places))
                query = head[n + 1][a:b]
                found = list(search(query, v[a:b], at[a:b]))
                offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(query, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[0] for f in found]), pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[1] for f in found]), kind)),
                    ],
                    ["query_id", "ids", "scores"],
                )

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "is_query")
    return dealt.select(*keys, "is_query", "vec_id", "v", "at").mapInArrow(run, PARTIAL.format(score))


def merge_best(partial: DataFrame, k: int, score: str) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best over all partial results; ties to the smaller id.

    Results of a query stream past in one task and only its ``k`` best are held.
    An id that several blocks report counts once.
    """
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, best = None, {}

        def ranked() -> list[tuple]:
            return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]

        for batch in batches:
            out: list[tuple] = []
            q = batch.column(0).to_pylist()
            for one, ids, scores in zip(q, batch.column(1), batch.column(2), strict=True):
                if one != query:
                    out += [(query, r, i, s) for r, (i, s) in enumerate(ranked(), 1)]
                    query, best = one, {}
                for i, s in zip(ids.values.to_pylist(), scores.values.to_pylist(), strict=True):
                    if best.get(i, s) <= s:
                        best[i] = s
                if len(best) > 8 * k:
                    best = dict(ranked())
            yield _rows(out, kind)
        if query is not None:
            yield _rows([(query, r, i, s) for r, (i, s) in enumerate(ranked(), 1)], kind)

    dealt = partial.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(run, f"query_id long, rank int, vec_id long, score {score}")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])
