"""Differences between snapshots as change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str = "path", revision: str = "revision", fields: list[str] | None = None) -> DataFrame:
    """``event_type``, ``path``, ``previous_path``, ``old_revision``, ``new_revision`` and, for modified rows, ``changed_fields``.

    A full outer join on the key gives created, deleted and modified rows. A deleted and a created row with one
    revision are a rename if that revision is alone on both sides; otherwise they stay two events.
    """
    fields = fields or []
    a = old.select(F.col(key).alias("k"), F.col(revision).alias("old_revision"), *[F.col(f).alias(f"o_{f}") for f in fields])
    b = new.select(F.col(key).alias("k"), F.col(revision).alias("new_revision"), *[F.col(f).alias(f"n_{f}") for f in fields])
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), "k", "full_outer")
    kind = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "deleted").when(~F.col("old_revision").eqNullSafe(F.col("new_revision")), "modified")
    changed = F.filter(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in fields]) if fields else F.array().cast("array<string>"), lambda x: x.isNotNull())
    both = both.withColumn("event_type", kind).where("event_type is not null")
    gone = both.where("event_type = 'deleted'").groupBy("old_revision").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("from_path"))
    come = both.where("event_type = 'created'").groupBy("new_revision").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("to_path"))
    renames = gone.where("n = 1").join(come.where("m = 1"), F.col("old_revision") == F.col("new_revision")).select("from_path", "to_path", "old_revision", "new_revision")
    moved = renames.select(F.explode(F.array(F.struct(F.lit("deleted").alias("event_type"), F.col("from_path").alias("k")), F.struct(F.lit("created").alias("event_type"), F.col("to_path").alias("k")))).alias("m")).select("m.event_type", "m.k")
    plain = both.join(moved, ["event_type", "k"], "left_anti").select(
        "event_type", F.col("k").alias("path"), F.lit(None).cast("string").alias("previous_path"), "old_revision", "new_revision",
        F.when(F.col("event_type") == "modified", changed).alias("changed_fields"),
    )
    renamed = renames.select(
        F.lit("renamed").alias("event_type"), F.col("to_path").alias("path"), F.col("from_path").alias("previous_path"), "old_revision", "new_revision",
        F.lit(None).cast("array<string>").alias("changed_fields"),
    )
    return plain.unionByName(renamed)


def suppress_known(events: DataFrame, own: DataFrame) -> DataFrame:
    """Events without the echoes of changes that were made here (same path and new revision)."""
    known = own.select(F.col("path").alias("__p"), F.col("new_revision").alias("__r"))
    return events.join(known, events["path"].eqNullSafe(F.col("__p")) & events["new_revision"].eqNullSafe(F.col("__r")), "left_anti")


def stale(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """``path`` and ``state`` (added, changed, removed) of a materialised table against a listing, by path and time."""
    a = listing.select("path", F.col("mtime").alias("now"))
    b = cached.select("path", F.col("mtime").alias("then"))
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def refresh(cached: DataFrame, listing: DataFrame, load) -> DataFrame:
    """The materialised table brought up to date: only added and changed paths are loaded. ``load(paths)`` returns their rows."""
    changes = stale(listing, cached)
    kept = cached.join(changes, "path", "left_anti")
    return kept.unionByName(load(changes.where("state <> 'removed'").select("path")))
