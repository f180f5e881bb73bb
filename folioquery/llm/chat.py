"""Chat formatting with collapse of cumulative snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise

_LINKS = "conv_id long, n_turns long, position long, h1 long, h2 long"


def render_turn(role: Column, text: Column) -> Column:
    """One turn of the rendered conversation."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rolling hash of every turn-prefix. Rows come sorted by conversation and turn.

    ``n_turns`` is set on the row of the whole conversation and 0 on the others. A
    row is held back until the next one shows whether its conversation goes on,
    so memory doesn't depend on the length of a conversation.
    """
    conv: object = ...
    state, held = b"", None
    out: list[tuple] = []
    for batch in batches:
        for c, h1, h2 in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                if held:
                    out.append((held[0], held[1], held[1], held[2], held[3]))
                conv, state, n = c, b"", 0
            elif held:
                out.append((held[0], 0, held[1], held[2], held[3]))
            n += 1
            state = hashlib.blake2b(state + h1.to_bytes(8, "big", signed=True) + h2.to_bytes(8, "big", signed=True), digest_size=16).digest()
            held = (c, n, int.from_bytes(state[:8], "big", signed=True), int.from_bytes(state[8:], "big", signed=True))
        if out:
            yield _batch(out)
            out = []
    if held:
        yield _batch([(held[0], held[1], held[1], held[2], held[3])])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "position", "h1", "h2"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse logged snapshots of growing conversations and render those that remain.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. Chat front ends log the whole
    conversation after every exchange, so most logged conversations are a
    prefix of a longer one. Each turn is hashed where it is read; a rolling
    128-bit hash then gives every turn-prefix a key. An anti-join removes the
    conversations whose whole key is a proper prefix of another, and of equal
    conversations all but the one with the smallest id. Only hashes move until
    the maximal conversations are known; their turns are then gathered once and rendered.

    Returns ``conv_id``, ``n_turns`` and ``rendered``.

    * null conv_id: no conversation; such rows are left out.
    * null turn: before all others. Null role: "user". Null text: empty.
    * rows that repeat a turn's number, role and text: one turn; different rows
      with one number: in order of role, then of the text's hash.
    * empty table: empty result. Other columns are not read.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keyed = clean.select(
        "*",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("turn"), "role", F.octet_length("role"), "text").alias("h2"),
    )
    hashed = (
        keyed.select("conv_id", "turn", "role", "h1", "h2")
        .distinct()
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "h1", "h2")
        .select("conv_id", "h1", "h2")
    )
    links = materialise(hashed.mapInArrow(_prefixes, _LINKS), "chat-prefixes")
    whole = links.where("n_turns > 0").groupBy("h1", "h2", "position").agg(F.min("conv_id").alias("conv_id"))
    parts = links.where("n_turns = 0").select("h1", "h2", "position").distinct()
    kept = whole.join(parts, ["h1", "h2", "position"], "left_anti").select("conv_id")
    turn = F.struct("turn", "role", "h1", "h2", "text")
    return (
        keyed.join(materialise(kept, "chat-kept"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set(turn)).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("rendered"),
        )
    )
