"""Admission, debouncing and throttling of events, in batches and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def admit(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All deliveries with their ``outcome``: the first of every event is accepted, the rest are duplicates."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return events.withColumn("outcome", F.when(nth == 1, "accepted").otherwise("duplicate"))


def admit_stream(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """A stream without repeated deliveries within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def debounce(events: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """Events after which ``seconds`` pass without another of their key: the last of a burst wins.

    Whether an event stays depends only on the next ``seconds``, so events are dealt by key and
    time slot (each also to the slot before), and a key with most of the events is spread over time.
    """
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))
    dealt = events.withColumn("__own", slot).withColumn("__slot", F.explode(F.array(F.col("__own"), F.col("__own") - 1)))
    nxt = F.lead(time).over(W.partitionBy(key, "__slot").orderBy(time, order))
    kept = dealt.withColumn("__next", nxt).where(F.col("__own") == F.col("__slot"))
    quiet = F.col("__next").isNull() | (F.col("__next") >= F.col(time) + F.expr(f"interval {seconds} seconds"))
    return kept.where(quiet).drop("__own", "__slot", "__next")


def throttle(events: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """Events at least ``seconds`` after the last one kept of their key: the first wins.

    Each decision needs the one before, so a key's events stream past in time order; one row is held.
    """
    step = seconds * 1_000_000
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if k != current or last is None:
                    current, last = k, None
                if last is None or t >= last + step:
                    last = t
                    keep.append(True)
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names).filter(pa.array(keep, pa.bool_()))

    sorted_ = events.repartition(key).sortWithinPartitions(key, time, order)
    extra = sorted_.select(*names, F.col(key).alias("__key"), F.unix_micros(F.col(time).cast("timestamp")).alias("__at"))
    return extra.mapInArrow(run, events.schema)


def _throttle_state(seconds: int):
    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values("at")
            keep = []
            for t in batch["at"]:
                good = last is None or t >= last + seconds * 1_000_000
                last = t if good else last
                keep.append(good)
            yield batch[keep]
        if last is not None:
            state.update((last,))

    return run


def throttle_stream(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Throttling on a stream; ``events`` has the key and ``at`` (microseconds). The state of a key is one number."""
    return events.groupBy(key).applyInPandasWithState(_throttle_state(seconds), events.schema, "last long", "append", "NoTimeout")


def _debounce_state(seconds: int, columns: list[str]):
    def run(key, batches, state):
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([held], columns=columns)
            return
        out = []
        rows = pd.concat(list(batches)).sort_values("at")
        for row in rows[columns].itertuples(index=False):
            if held is not None and row.at >= held[columns.index("at")] + seconds * 1_000_000:
                out.append(held)
            held = list(row)
        state.update(tuple(held))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame(out, columns=columns)

    return run


def debounce_stream(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Debouncing on a stream: a key's event is given out when a later one comes after the quiet time, or at a timeout."""
    schema = events.schema
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return events.groupBy(key).applyInPandasWithState(_debounce_state(seconds, events.columns), schema, shape, "append", "ProcessingTimeTimeout")


def concurrency(runs: DataFrame, group: str, order: list[Column], mode: str) -> DataFrame:
    """What becomes of runs that are asked for while others of their group are open: ``outcome`` by mode.

    ``allow``: all run. ``skip``: the first runs, others are skipped. ``queue``: the first runs, others wait. ``replace``: the last one runs, earlier ones are cancelled.
    """
    if mode == "allow":
        return runs.withColumn("outcome", F.lit("run"))
    backwards = [o.desc() for o in order]
    nth = F.row_number().over(W.partitionBy(group).orderBy(*(backwards if mode == "replace" else order)))
    other = {"skip": "skipped", "queue": "queued", "replace": "cancelled"}[mode]
    return runs.withColumn("outcome", F.when(nth == 1, "run").otherwise(other))


def windowed(events: DataFrame, time: str, length: str, delay: str, by: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window, for batches and for streams with a watermark."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    return events.groupBy(F.window(F.col(time).cast("timestamp"), length, slide), *by).agg(*aggregates)


def ordered_feed(events: DataFrame, head: int, order: list[Column]) -> DataFrame:
    """Events with dense watermarks after ``head``: numbered in ranges, so no task holds them all."""
    from folioquery.operators.quality import generate_sequence

    return generate_sequence(events.withColumn("watermark", F.lit(None).cast("long")), "watermark", order, start=head + 1)
