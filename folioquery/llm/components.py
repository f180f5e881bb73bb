"""Connected components of a sparse graph, without hubs in any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    By contraction: every node points at its smallest neighbour if that is smaller, pointers are
    followed to their roots, and edges become edges between different
    roots. A round at least halves the nodes that still have edges, and reads only what the last
    one left. Minima are combined before the shuffle, and joins read
    plain tables in the shared folder, so Spark can split a root that a third of all nodes share.

    Null ends and self-loops are ignored; repeated edges count once.
    """
    kept = edges.where("a is not null and b is not null and a <> b")
    pairs = materialise(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while found is None or not pairs.isEmpty():
        turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = pairs.select(F.explode(turned).alias("e")).select(F.col("e.a").alias("node"), F.col("e.b").alias("near"))
        roots = _compress(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = pairs.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        pairs = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if found is None:
            found = roots.select("node", F.col("root").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), "root")
            found = materialise(found.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    return found


def _compress(parents: DataFrame) -> DataFrame:
    """Pointers followed to their ends by doubling."""
    parents = materialise(parents, "roots")
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        higher = materialise(parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "roots")
        parents = higher.select("node", "root")
        if higher.where("moved").isEmpty():
            return parents
