"""Projections of sealed events: rebuilt tables, dashboards, previews of reversals, epochs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.functions.changes import key_columns, position, row_key
from lodeline.operators.changelog import deduplicated, state
from lodeline.operators.ordered import fold


def field_table(items: DataFrame) -> DataFrame:
    """One row per changed field of change items: change_id, db_id, object_name, operation, column, old, new (JSON tokens), data_type, sensitive."""
    f = F.explode("fields").alias("f")
    return items.select("change_id", "db_id", "object_name", "operation", f).select("change_id", "db_id", "object_name", "operation", F.col("f.path").alias("column"), "f.old", "f.new", "f.data_type", "f.sensitive")


def top_objects(changes: DataFrame, n: int) -> DataFrame:
    """The n objects with most changes; ties by name. A limit is the feature here."""
    return changes.groupBy("object").agg(F.count(F.lit(1)).alias("n_changes")).orderBy(F.desc("n_changes"), "object").limit(n)


def per_minute(events: DataFrame, ts: str, label: str) -> DataFrame:
    """Events of each minute and label: minute, label, n."""
    return events.groupBy(F.window(ts, "1 minute").alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), label, "n")


#: What undoes what.
INVERSE = {"INSERT": "DELETE", "DELETE": "INSERT", "UPDATE": "UPDATE"}


def reversals(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """What would undo each row change, once per change, and whether the row has moved on since.

    Columns: db_id, object, row_key, file_no, binlog_pos, row_no, operation,
    inverse, drifted. A change is drifted unless it wrote its row last and the
    row still lives; a DELETE is drifted if the row lives again. Decided against
    the state by key, an equi-join. DDL and TRUNCATE can't be undone from images.
    """
    keys = key_columns(monitored)
    inverse = F.when(F.col("operation") == "INSERT", "DELETE").when(F.col("operation") == "DELETE", "INSERT").when(F.col("operation") == "UPDATE", "UPDATE")
    image = F.when(F.col("operation") == "DELETE", F.col("before_image")).otherwise(F.col("after_image"))
    rows = position(changes).where(F.col("operation").isin(*INVERSE)).select("db_id", "object", "file_no", "binlog_pos", "row_no", "change_id", "operation", inverse.alias("inverse"), row_key(image, F.col("object"), keys).alias("row_key"))
    live = state(changes, monitored).select("db_id", "object", "row_key", F.struct("at.file_no", "at.binlog_pos", "at.row_no").alias("at"))
    df = deduplicated(rows).join(live, ["db_id", "object", "row_key"], "left")
    own = F.struct("file_no", "binlog_pos", "row_no")
    drifted = F.when(F.col("operation") == "DELETE", F.col("at").isNotNull()).otherwise(~F.col("at").eqNullSafe(own))
    return df.select("db_id", "object", "row_key", "file_no", "binlog_pos", "row_no", "operation", "inverse", drifted.alias("drifted"))


def epoch_coverage(emitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Coverage of each snapshot epoch's tables: complete, incomplete or unknown.

    emitted: db_id, epoch_id, object; expected: db_id, epoch_id, object, expected_rows (null if unknown).
    """
    n = emitted.groupBy("db_id", "epoch_id", "object").agg(F.count(F.lit(1)).alias("emitted_rows"))
    df = expected.join(n, ["db_id", "epoch_id", "object"], "full_outer").withColumn("emitted_rows", F.coalesce("emitted_rows", F.lit(0)))
    status = F.when(F.col("expected_rows").isNull(), "unknown").when(F.col("emitted_rows") >= F.col("expected_rows"), "complete").otherwise("incomplete")
    return df.withColumn("status", status)


def epoch_manifests(epochs: DataFrame, tables: DataFrame) -> DataFrame:
    """Manifests of snapshot epochs: epochs with core (canonical), manifest_hash, prev_row_hash, row_hash.

    epochs: db_id, epoch_id, n (order in the database), server_uuid, binlog_file,
    binlog_pos, start_ts, handoff_gtid, supersedes. tables: db_id, epoch_id,
    object, expected_rows, emitted_rows. Lists are as long as an epoch has tables.
    """
    entry = C.obj({"object": C.token(F.col("object")), "expected_rows": C.token(F.col("expected_rows"), "number"), "emitted_rows": C.token(F.col("emitted_rows"), "number")})
    lists = tables.groupBy("db_id", "epoch_id").agg(F.array_sort(F.collect_list(F.struct("object", entry.alias("text")))).alias("_tables"))
    text = lambda name: C.token(F.col(name))
    core = C.obj({
        "kind": F.lit('"snapshot_epoch_manifest"'), "schema_version": F.lit('"epoch-manifest-1.0"'), **{n: text(n) for n in ("epoch_id", "db_id", "server_uuid", "handoff_gtid", "supersedes")}, "snapshot_start_ts": text("start_ts"),
        "snapshot_start_watermark": C.obj({"binlog_file": text("binlog_file"), "binlog_pos": C.token(F.col("binlog_pos"), "number")}), "tables": C.arr(F.transform(F.coalesce("_tables", F.array().cast("array<struct<object:string,text:string>>")), lambda t: t["text"])),
    })
    df = epochs.join(lists, ["db_id", "epoch_id"], "left").withColumn("core", core).drop("_tables").withColumn("manifest_hash", C.sha(F.col("core")))

    def step(state, row):
        before = state or C.GENESIS
        own = "sha256:" + hashlib.sha256((before + row[2]).encode()).hexdigest()
        return own, (before, own)

    return df.join(fold(df, "db_id", ["n"], ["manifest_hash"], "prev_row_hash string, row_hash string", step), ["db_id", "n"])


def current_epochs(epochs: DataFrame) -> DataFrame:
    """The epoch of each database that supersedes the others: the greatest watermark (file number, position), then handoff; ties by id."""
    return epochs.groupBy("db_id").agg(F.max_by("epoch_id", F.struct("file_no", "binlog_pos", F.coalesce("handoff_no", F.lit(-1)), "epoch_id")).alias("epoch_id"))
