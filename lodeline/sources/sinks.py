"""Sinks: append without overwriting, upsert by key, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.canonical import object_key


class AlreadyThere(ValueError):
    pass


def put_new(objects: DataFrame, path: str, key: str = "key") -> None:
    """Appends objects whose keys aren't there; ``AlreadyThere`` and nothing written if one is, or if keys repeat.

    The input is read for each of the two checks and for writing, and the checks
    and the write aren't one step: of several writers at one path, one must be let
    in at a time (a store that refuses to overwrite does that by itself).
    """
    spark = objects.sparkSession
    repeated = objects.groupBy(key).count().where("count > 1").limit(1).count()
    try:
        there = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - the path doesn't exist yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        there = None
    if repeated or (there is not None and objects.join(there.select(key), key, "left_semi").limit(1).count()):
        raise AlreadyThere(f"an object of {path} would be overwritten")
    objects.write.mode("append").parquet(path)


def retention_decision(held: Column, retain_until: Column, now: Column, action: Column, new_until: Column | None = None) -> Column:
    """Allowed, or why not: delete needs no hold and expired retention, extend only moves forward."""
    later = F.lit(False) if new_until is None else new_until > retain_until
    return (
        F.when((action == "delete") & held, "DENY_HOLD").when((action == "delete") & (retain_until > now), "DENY_RETENTION")
        .when((action == "extend") & ~F.coalesce(later, F.lit(False)), "DENY_BACKWARD").when(action.isin("delete", "extend"), "ALLOW").otherwise("DENY_UNKNOWN")
    )


def latest_by_key(base: DataFrame | None, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: of base and incoming the row of each key with the greatest ``order``."""
    both = incoming if base is None else base.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*key, "_x.*")


def object_rows(events: DataFrame) -> DataFrame:
    """Sealed events as objects: key, content (canonical JSON)."""
    return events.select(object_key(F.col("db_id"), F.col("segment_id"), F.col("seq"), "cce").alias("key"), F.col("core").alias("content"))


def exit_code(report: DataFrame) -> int:
    """0 if every database passes, 1 if one fails, 2 if there is nothing to judge."""
    verdicts = {r["overall"] for r in report.select("overall").distinct().collect()}
    return 2 if not verdicts else 0 if verdicts == {"PASS"} else 1
