"""Attestation of a source's settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import canonical as C

MIN_RETENTION_S = 86_400

#: The settings that are read.
VARIABLES = ("log_bin", "binlog_format", "binlog_row_image", "gtid_mode", "gtid_strict_mode", "binlog_expire_logs_seconds", "expire_logs_days", "server_uuid", "server_id")


def config_rows(variables: DataFrame) -> DataFrame:
    """Settings as one row per source, from rows (db_id, engine, name, value).

    Names in any case; empty values are null; retention in seconds, else days.
    """
    name, value = F.lower("name"), F.when(F.col("value") != "", F.col("value"))
    wide = variables.groupBy("db_id", "engine").agg(*[F.max(F.when(name == v, value)).alias(v) for v in VARIABLES])
    mysql = F.col("engine") == "mysql"
    seconds = F.coalesce(F.col("binlog_expire_logs_seconds").try_cast("bigint"), F.col("expire_logs_days").try_cast("bigint") * 86_400)
    return wide.select(
        "db_id", "engine", F.upper("log_bin").alias("log_bin"), F.upper("binlog_format").alias("binlog_format"), F.upper("binlog_row_image").alias("binlog_row_image"),
        F.when(mysql, F.upper("gtid_mode")).alias("gtid_mode"), F.when(F.col("engine") == "mariadb", F.upper("gtid_strict_mode")).alias("gtid_strict_mode"),
        seconds.alias("binlog_expire_logs_seconds"), F.when(mysql, F.col("server_uuid")).otherwise(F.col("server_id")).alias("server_uuid"),
    )


# The notes' texts in ``findings``; they end up in hashed events.


def findings(min_retention_s: int = MIN_RETENTION_S) -> Column:
    """Array of struct(rank, severity, kind, note) of what is wrong, in the order the settings are looked at.

    rank 1 is DEGRADED, 2 COMPROMISED, 0 a note only. Every setting that couldn't be read counts.
    """
    one = lambda cond, rank, severity, kind, note: F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), note.alias("note")))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    down, weak = "CONFIG_DOWNGRADE", "FIDELITY_DEGRADED"
    c, mysql = F.col, F.col("engine") == "mysql"
    checks = F.array(
        one(c("log_bin") == "OFF", 2, "critical", down, say("log_bin is OFF: binary logging disabled — no change capture")),
        one(c("log_bin").isNull(), 1, "high", weak, say("log_bin could not be read: capture cannot be confirmed")),
        one(c("binlog_format") != "ROW", 1, "critical", down, say("binlog_format is ", c("binlog_format"), " (expected ROW): field-level capture lost")),
        one(c("binlog_format").isNull(), 1, "high", weak, say("binlog_format could not be read")),
        one(c("binlog_row_image") != "FULL", 1, "critical", down, say("binlog_row_image is ", c("binlog_row_image"), " (expected FULL): before-image lost")),
        one(c("binlog_row_image").isNull(), 1, "high", weak, say("binlog_row_image could not be read")),
        one(mysql & (c("gtid_mode") != "ON"), 1, "critical", down, say("gtid_mode is ", c("gtid_mode"), " (expected ON): completeness proof impossible")),
        one(mysql & c("gtid_mode").isNull(), 1, "high", weak, say("gtid_mode could not be read")),
        one(~mysql & (c("gtid_strict_mode") != "ON"), 0, "none", "NOTE", say("gtid_strict_mode is not ON (recommended for MariaDB GTID continuity)")),
        one(c("binlog_expire_logs_seconds") < min_retention_s, 1, "high", down, say("binlog retention ", c("binlog_expire_logs_seconds"), f"s is below the {min_retention_s}s threshold (gap risk)")),
        one(c("binlog_expire_logs_seconds").isNull(), 1, "medium", weak, say("binlog retention could not be read: sufficiency cannot be confirmed")),
    )
    return F.filter(checks, lambda x: x.isNotNull())


def assessed(configs: DataFrame, min_retention_s: int = MIN_RETENTION_S) -> DataFrame:
    """Adds state (HEALTHY only if every setting was read and is right), degraded_reason, notes and findings."""
    df = configs.withColumn("findings", findings(min_retention_s))
    rank = F.coalesce(F.array_max(F.transform("findings", lambda x: x["rank"])), F.lit(0))
    state = F.when(rank == 2, "COMPROMISED").when(rank == 1, "DEGRADED").otherwise("HEALTHY")
    notes = F.transform("findings", lambda x: x["note"])
    return df.withColumn("state", state).withColumn("notes", notes).withColumn("degraded_reason", F.when(rank > 0, F.get("notes", F.lit(0))))


def sampled(expected: DataFrame, configs: DataFrame, sampled_at: Column) -> DataFrame:
    """A snapshot for every expected source (db_id, engine); one without a reading is DEGRADED with null settings.

    config_snapshot_id is ``cfg-`` and 16 hex digits of the canonical settings.
    """
    joined = expected.select("db_id", "engine").join(configs.drop("engine"), "db_id", "left")
    df = assessed(joined).withColumn("sampled_at", sampled_at)
    names = ["db_id", "engine", "sampled_at", "binlog_format", "binlog_row_image", "gtid_mode", "gtid_strict_mode", "log_bin", "server_uuid"]
    text = C.obj({**{n: C.token(F.col(n)) for n in names}, "binlog_expire_logs_seconds": C.token(F.col("binlog_expire_logs_seconds"), "number")})
    return df.withColumn("config_snapshot_id", F.concat(F.lit("cfg-"), F.substring(F.sha2(text, 256), 1, 16)))


def audit_plugin(variables: DataFrame, plugins: DataFrame) -> DataFrame:
    """Whether native audit logging is active: db_id, logging_active, source, plugin_name, tamper_indicators.

    variables: db_id, name, value; plugins: db_id, plugin_name, plugin_status.
    """
    on = variables.groupBy("db_id").agg(F.bool_or(F.lower("name").isin("general_log", "server_audit_logging") & (F.upper("value") == "ON")).alias("by_variable"))
    active = F.upper("plugin_name").contains("AUDIT") & (F.upper("plugin_status") == "ACTIVE")
    by_plugin = plugins.groupBy("db_id").agg(F.min(F.when(active, F.col("plugin_name"))).alias("plugin_name"))
    df = on.join(by_plugin, "db_id", "full_outer").withColumn("by_variable", F.coalesce("by_variable", F.lit(False)))
    live = F.col("plugin_name").isNotNull() | F.col("by_variable")
    return df.select(
        "db_id", live.alias("logging_active"), F.when(F.col("plugin_name").isNotNull(), "plugin").when(F.col("by_variable"), "general_log").otherwise("unknown").alias("source"),
        "plugin_name", F.when(live, F.array().cast("array<string>")).otherwise(F.array(F.lit("AUDIT_PLUGIN_DISABLED"))).alias("tamper_indicators"),
    )


def worst_state(*states: Column) -> Column:
    rank = F.greatest(*[F.when(s == "COMPROMISED", 2).when(s == "DEGRADED", 1).otherwise(0) for s in states])
    return F.when(rank == 2, "COMPROMISED").when(rank == 1, "DEGRADED").otherwise("HEALTHY")


def combined_fidelity(df: DataFrame) -> DataFrame:
    """Fidelity and completeness of events joined: adds state and reason. Needs fidelity_state, fidelity_reason (null: unattested) and gap_detected (null: not attested)."""
    known = F.col("gap_detected").isNotNull()
    base = F.coalesce("fidelity_state", F.lit("DEGRADED"))
    reason = F.when(F.col("fidelity_state").isNull(), "no fidelity attestation available").otherwise(F.col("fidelity_reason"))
    state = worst_state(base, F.when(~known | F.col("gap_detected"), "DEGRADED").otherwise("HEALTHY"))
    why = F.coalesce(reason, F.when(~known, "completeness not attested").when(F.col("gap_detected"), "completeness gap detected"))
    return df.withColumn("state", state).withColumn("reason", F.when(state != "HEALTHY", why))
