"""Completeness of a source's stream: gaps, phases, liveness, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions import gtid
from lodeline.operators.ordered import carry

STALL_MS, IDLE_MS, LAG_MS = 60_000, 20_000, 30_000


def consumed_runs(changes: DataFrame) -> DataFrame:
    """Merged GTID intervals consumed of each db_id and key: db_id, key, start, end."""
    spans = changes.where(F.col("gtid").isNotNull()).select("db_id", F.explode(gtid.intervals(F.col("gtid"), F.col("engine"))).alias("i")).select("db_id", "i.*")
    return gtid.merged(spans, ["db_id", "key"])


def gap_alarms(runs: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """One alarm for each gap's signature: db_id, signature, kind, severity."""
    inner = gtid.summary(runs, ["db_id", "key"]).where("gap_detected").select("db_id", F.concat(F.lit("internal:"), "key").alias("signature"))
    if missing is not None:
        inner = inner.unionByName(missing.select("db_id", F.concat(F.lit("missing:"), "key", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("signature")))
    return inner.distinct().select("db_id", "signature", F.lit("COMPLETENESS_GAP").alias("kind"), F.lit("critical").alias("severity"))


def handoff_events(stream: DataFrame, key: str = "db_id", order: str = "change_id", block: int = 65_536) -> DataFrame:
    """Phase transitions of each source in order of arrival: key, order, type, from_phase, to_phase.

    Nothing to snapshot starts a snapshot; any phase to handoff completes it;
    snapshot to streaming completes it and resumes streaming, in this order; any
    other phase to streaming resumes it. Equal neighbours make no event.
    """
    df = stream.where(F.col("snapshot_phase").isNotNull()).select(key, order, "snapshot_phase", F.floor(F.col(order) / block).cast("bigint").alias("_block"))
    df = carry(df, [key], "_block", [order], {"from_phase": F.col("snapshot_phase")})
    prev, now = F.col("from_phase"), F.col("snapshot_phase")
    event = lambda cond, n, name: F.when(cond, F.struct(F.lit(n).alias("n"), F.lit(name).alias("type")))
    kinds = F.array(
        event(prev.isNull() & (now == "snapshot"), 0, "snapshot_start"),
        event((now == "handoff") | ((now == "streaming") & prev.eqNullSafe("snapshot")), 1, "snapshot_complete"),
        event(now == "streaming", 2, "streaming_resumed"),
    )
    moved = df.where(prev.isNull() | (prev != now))
    return moved.select(key, order, "from_phase", now.alias("to_phase"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("e")).select(key, order, "e.type", "from_phase", "to_phase")


def liveness(activity: DataFrame, now_ms: int, key: str = "db_id", stall_ms: int = STALL_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """live, idle or stalled for each source.

    activity: key, at_ms, is_event (false for heartbeats). No activity for longer
    than stall_ms is stalled; no event yet, or none for longer than idle_ms, is idle.
    """
    last = activity.groupBy(key).agg(F.max("at_ms").alias("last_activity_ms"), F.max(F.when(F.col("is_event"), F.col("at_ms"))).alias("last_event_ms"))
    state = (
        F.when(F.col("last_activity_ms").isNull(), "idle").when(F.lit(now_ms) - F.col("last_activity_ms") > stall_ms, "stalled")
        .when(F.col("last_event_ms").isNull() | (F.lit(now_ms) - F.col("last_event_ms") > idle_ms), "idle").otherwise("live")
    )
    return last.withColumn("liveness", state)


def lag_alarms(stream: DataFrame, threshold_ms: int = LAG_MS) -> DataFrame:
    """Events that were received later than the threshold after the source wrote them: high beyond three times of it. Needs received_ms and source_ms."""
    lag = F.col("received_ms") - F.col("source_ms")
    return stream.where(lag > threshold_ms).withColumn("lag_ms", lag).withColumn("severity", F.when(lag > 3 * threshold_ms, "high").otherwise("medium"))


def stall_alarms(live: DataFrame, now_ms: int, key: str = "db_id", stall_ms: int = STALL_MS) -> DataFrame:
    """An alarm for each source without activity for longer than stall_ms, as ``liveness`` gives them: key, kind, silent_ms, severity (critical beyond five times of it)."""
    silent = F.lit(now_ms) - F.col("last_activity_ms")
    return live.where("liveness = 'stalled'").select(key, F.lit("SOURCE_STALLED").alias("kind"), silent.alias("silent_ms"), F.when(silent > 5 * stall_ms, "critical").otherwise("high").alias("severity"))


def new_alarms(raised: DataFrame, known: DataFrame | None) -> DataFrame:
    """Alarms (db_id, signature, ...) whose signature wasn't raised before; append them to the table of known ones with ``sinks.put_new``."""
    once = raised.dropDuplicates(["db_id", "signature"])
    return once if known is None else once.join(known.select("db_id", "signature").distinct(), ["db_id", "signature"], "left_anti")


def updates(runs: DataFrame, activity: DataFrame, now_ms: int) -> DataFrame:
    """Completeness record of each source: consumed set, gap flag, liveness."""
    flags = gtid.summary(runs, ["db_id", "key"]).groupBy("db_id").agg(F.bool_or("gap_detected").alias("gap_detected"))
    return gtid.set_text(runs, ["db_id"]).join(flags, "db_id").join(liveness(activity, now_ms), "db_id", "full_outer")
