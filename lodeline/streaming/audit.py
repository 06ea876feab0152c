"""The stream form: sources, deduplication, late data, segments, upserts.

Each works on micro-batches with a checkpoint: offsets are committed after the
sink, so delivery is at least once and the sinks below are idempotent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeline.functions.canonical import GENESIS
from lodeline.operators import segments
from lodeline.sources.sinks import latest_by_key


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files now there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, key: list[str], ts: str | None = None, keep: str | None = None) -> DataFrame:
    """The first arrival of each key. Without ``keep`` the state is unbounded and exact; with it (as ``2 days``) repeats later than that pass."""
    if keep is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(key)


def tumbling_counts(stream: DataFrame, by: list[str], ts: str, window: str, lateness: str) -> DataFrame:
    """Counts of closed windows; rows later than ``lateness`` are dropped here and belong to ``late_rows``."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def rerouted(batch: DataFrame, ts: str, window_ms: int, closed_before_ms: int) -> DataFrame:
    """Rows of a micro-batch with their window: late rows, whose window is closed, go to the first open one and are marked."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    start = at - F.pmod(at, F.lit(window_ms))
    late = start + window_ms <= closed_before_ms
    open_ = F.lit(closed_before_ms - closed_before_ms % window_ms)
    return batch.withColumn("late", late).withColumn("window_ms", F.when(late, open_).otherwise(start))


def segmented(stream: DataFrame, max_events: int = segments.MAX_EVENTS, max_age_ms: int = segments.MAX_AGE_MS) -> DataFrame:
    """Segment of every event by count and age, with processing-time timers that close aged segments: db_id, arrival, segment_sequence.

    State per database: number, opening time and count of the open segment.
    Events of a micro-batch are taken in order of arrival. Needs db_id, arrival, at_ms.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, opened, n = state.get if state.exists else (0, None, 0)
        if state.hasTimedOut:
            if n:
                sequence, opened, n = sequence + 1, None, 0
            state.update((sequence, opened, n))
            return
        out = []
        # two numbers an event: the micro-batch, which the source's limit bounds, must be put in order
        pairs = [f[["arrival", "at_ms"]].to_numpy() for f in frames]
        events = np.concatenate(pairs)
        events = events[np.argsort(events[:, 0], kind="stable")]
        for arrival, at in events.tolist():
            if n and (n >= max_events or (opened is not None and at - opened >= max_age_ms)):
                sequence, opened, n = sequence + 1, None, 0
            opened = at if opened is None else opened
            n += 1
            out.append((key[0], arrival, sequence))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["db_id", "arrival", "segment_sequence"])
                out = []
        state.update((sequence, opened, n))
        state.setTimeoutDuration(max_age_ms)
        yield pd.DataFrame(out, columns=["db_id", "arrival", "segment_sequence"])

    return stream.select("db_id", "arrival", "at_ms").groupBy("db_id").applyInPandasWithState(
        step, "db_id string, arrival bigint, segment_sequence bigint", "sequence bigint, opened bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def guarded(stream: DataFrame) -> DataFrame:
    """Outcome of every arrival of an event: EMIT for the first of an id, DUPLICATE for later ones with its hash, else INTEGRITY_VIOLATION.

    State is the first hash of each id, kept for good, as a repeat may come at any
    time. Needs envelope_id, event_hash, arrival; arrivals of a micro-batch are taken in order.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = sorted((int(n), h) for f in frames for n, h in zip(f["arrival"], f["event_hash"], strict=True))
        out = []
        for arrival, own in rows:
            out.append((key[0], arrival, "EMIT" if first is None else "DUPLICATE" if own == first else "INTEGRITY_VIOLATION"))
            first = own if first is None else first
        state.update((first,))
        yield pd.DataFrame(out, columns=["envelope_id", "arrival", "outcome"])

    return stream.select("envelope_id", "arrival", "event_hash").groupBy("envelope_id").applyInPandasWithState(step, "envelope_id string, arrival bigint, outcome string", "hash string", "append", GroupStateTimeout.NoTimeout)


def chained(stream: DataFrame) -> DataFrame:
    """The hash chain of each database along its arrivals: db_id, arrival, prev_row_hash, row_hash. State is the last row hash. Needs db_id, arrival, event_hash."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else GENESIS
        rows = sorted((int(n), h) for f in frames for n, h in zip(f["arrival"], f["event_hash"], strict=True))
        out = []
        for arrival, event_hash in rows:
            own = "sha256:" + hashlib.sha256((before + event_hash).encode()).hexdigest()
            out.append((key[0], arrival, before, own))
            before = own
        state.update((before,))
        yield pd.DataFrame(out, columns=["db_id", "arrival", "prev_row_hash", "row_hash"])

    return stream.select("db_id", "arrival", "event_hash").groupBy("db_id").applyInPandasWithState(step, "db_id string, arrival bigint, prev_row_hash string, row_hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def consumed(stream: DataFrame) -> DataFrame:
    """The consumed set of each source and key after every micro-batch that adds to it: db_id, key, runs (``1-5:7``), high_watermark, gap_detected.

    State is the merged runs, as many as there are holes. Needs db_id, key, start, end (intervals).
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = [tuple(map(int, x.split("-"))) for x in state.get[0].split(":")] if state.exists else []
        spans += [(int(a), int(b)) for f in frames for a, b in zip(f["start"], f["end"], strict=True) if a == a and b == b and a <= b]
        runs: list[list[int]] = []
        for a, b in sorted(spans):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        if not runs:
            return
        state.update((":".join(f"{a}-{b}" for a, b in runs),))
        text = ":".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)
        yield pd.DataFrame([(*key, text, runs[-1][1], len(runs) > 1)], columns=["db_id", "key", "runs", "high_watermark", "gap_detected"])

    return stream.select("db_id", "key", "start", "end").groupBy("db_id", "key").applyInPandasWithState(
        step, "db_id string, key string, runs string, high_watermark bigint, gap_detected boolean", "runs string", "update", GroupStateTimeout.NoTimeout
    )


def append_sink(path: str):
    """A foreachBatch function that publishes each micro-batch once: a folder per batch number, so a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upsert_sink(path: str, key: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in versioned folders below ``path``; a batch that is replayed writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        latest_by_key(base, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
