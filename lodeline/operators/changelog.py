"""Problem 3: applying a stream of inserts, updates and deletes.

Signed multiset: each change, counted once, contributes minus one for its
before-image's row and plus one for its after-image's row; TRUNCATE contributes
minus whatever the object holds, so what came before it is void. The signs of a
row are summed in the order of the log, beginning with its base: 1 if it existed
before the feed began, as its first contribution is a minus. A table is a set by
its key, so the running sum is clamped to 0..1: a write of a row that exists
replaces it, a removal of a row that doesn't exist does nothing. Rows whose sum
is positive are retained.

Adding a sign and clamping is a function x -> least(high, greatest(low, x + sum)),
and such functions compose to one of their kind. So the signs of a row are folded
to one function inside a block of the log, and the blocks' functions in their
order: no row's history is gathered in one place, however hot its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.changes import key_columns, position, row_key


def _at(step: int) -> Column:
    return F.struct("file_no", "binlog_pos", "row_no", F.lit(step).alias("step"), "binlog_file")


def contributions(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """One row per change and image: (db_id, object, row_key, sign, at, image).

    Repeats are taken out by (db_id, file number, position, row number) before;
    of several deliveries the one with the smallest change_id counts. DDL
    contributes nothing. An image without its key contributes nothing.
    """
    keys = key_columns(monitored)
    once = deduplicated(
        position(changes)
        .where(F.col("operation").isin("INSERT", "UPDATE", "DELETE"))
        .select(
            "db_id", "object", "file_no", "binlog_pos", "row_no", "binlog_file", "change_id",
            F.when(F.col("operation") != "INSERT", row_key(F.col("before_image"), F.col("object"), keys)).alias("minus_key"),
            F.when(F.col("operation") != "DELETE", row_key(F.col("after_image"), F.col("object"), keys)).alias("plus_key"),
        )
    )
    signed = F.explode(
        F.array(
            F.struct(F.lit(-1).alias("sign"), F.col("minus_key").alias("row_key"), _at(0).alias("at")),
            F.struct(F.lit(1).alias("sign"), F.col("plus_key").alias("row_key"), _at(1).alias("at")),
        )
    )
    return once.select("db_id", "object", signed.alias("c")).select("db_id", "object", "c.row_key", "c.sign", "c.at").where(F.col("row_key").isNotNull())


def deduplicated(changes: DataFrame) -> DataFrame:
    """One row for each (db_id, file_no, binlog_pos, row_no): that of the smallest change_id.

    A hash aggregation with min_by, so repeats collapse before the shuffle.
    """
    rest = [c for c in changes.columns if c not in ("db_id", "file_no", "binlog_pos", "row_no")]
    return (
        changes.groupBy("db_id", "file_no", "binlog_pos", "row_no")
        .agg(F.min_by(F.struct(*rest), F.col("change_id")).alias("x"))
        .select("db_id", "file_no", "binlog_pos", "row_no", "x.*")
    )


#: Bytes of a log file that make one block; with the file's number it bounds what is folded at once.
BLOCK_BYTES = 1 << 20
#: Blocks folded at once; runs of so many files are folded before the whole.
RUN_FILES = 1024

_ADD = "struct<sum:int,low:int,high:int>"


def _add(sign: Column) -> Column:
    """One contribution as a function of the multiplicity before it: clamp(x + sign) to 0..1."""
    return F.struct(sign.cast("int").alias("sum"), F.lit(0).alias("low"), F.lit(1).alias("high"))


def _then(first: Column, second: Column) -> Column:
    """The function that applies ``first``, then ``second``."""
    bound = lambda x: F.least(second["high"], F.greatest(second["low"], x + second["sum"]))
    return F.struct((first["sum"] + second["sum"]).alias("sum"), bound(first["low"]).alias("low"), bound(first["high"]).alias("high"))


def _folded(functions: Column) -> Column:
    """An array of struct(order, f) folded to one function."""
    inorder = F.transform(F.array_sort(functions), lambda x: x["f"])
    return F.aggregate(inorder, F.from_json(F.lit('{"sum":0,"low":0,"high":1}'), _ADD), _then)


def state(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """Rows alive after all changes.

    Columns: db_id, object, row_key, at (position of the last write), total (sum
    of the signs), base (1 if the row existed before the feed, or before what
    TRUNCATE left of it) and multiplicity, the clamped sum from base on, which is
    positive. An empty feed gives no rows.
    """
    emptied = (
        position(changes)
        .where(F.col("operation") == "TRUNCATE")
        .groupBy("db_id", "object")
        .agg(F.max(F.struct("file_no", "binlog_pos", "row_no")).alias("emptied"))
    )
    key = ["db_id", "object", "row_key"]
    signs = contributions(changes, monitored).join(emptied, ["db_id", "object"], "left")
    signs = signs.where(F.col("emptied").isNull() | (F.struct("at.file_no", "at.binlog_pos", "at.row_no") > F.col("emptied")))
    write = F.when(F.col("sign") > 0, F.col("at"))
    blocks = signs.groupBy(*key, F.col("at.file_no").alias("file_no"), F.floor(F.col("at.binlog_pos") / BLOCK_BYTES).alias("block")).agg(
        _folded(F.collect_list(F.struct(F.struct("at.binlog_pos", "at.row_no", "at.step").alias("order"), _add(F.col("sign")).alias("f")))).alias("f"), F.max(write).alias("at"), F.min(F.struct("at", "sign")).alias("first"))
    runs = blocks.groupBy(*key, F.floor(F.col("file_no") / RUN_FILES).alias("run")).agg(
        _folded(F.collect_list(F.struct(F.struct("file_no", "block").alias("order"), "f"))).alias("f"), F.max("at").alias("at"), F.min("first").alias("first"))
    whole = runs.groupBy(*key).agg(_folded(F.collect_list(F.struct(F.struct("run").alias("order"), "f"))).alias("f"), F.max("at").alias("at"), F.min("first").alias("first"))
    base = F.when(F.col("first.sign") < 0, 1).otherwise(0)
    held = whole.select(*key, "at", F.col("f.sum").alias("total"), base.alias("base"), F.least("f.high", F.greatest(F.col("f.low"), base + F.col("f.sum"))).alias("multiplicity"))
    return held.where(F.col("multiplicity") > 0)


def current_rows(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """The rows of every monitored table with their last image.

    The state is joined to the change that wrote each row last, by the change's
    identity (db_id, file number, position, row number), which has no hot values.
    """
    live = state(changes, monitored).select("db_id", "row_key", F.col("at.file_no").alias("file_no"), F.col("at.binlog_pos").alias("binlog_pos"), F.col("at.row_no").alias("row_no"))
    images = deduplicated(
        position(changes)
        .where(F.col("operation").isin("INSERT", "UPDATE"))
        .select("db_id", "object", "file_no", "binlog_pos", "row_no", "binlog_file", "change_id", "after_image")
    )
    return live.join(images, ["db_id", "file_no", "binlog_pos", "row_no"]).select(
        "db_id", F.col("object").alias("object_name"), "row_key", "binlog_file", "binlog_pos", "row_no", F.col("after_image").alias("image")
    )


def p3_found(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """(db_id, object_name, row_key, binlog_file, binlog_pos, row_no) of each row with a positive multiplicity."""
    return state(changes, monitored).select(
        "db_id", F.col("object").alias("object_name"), "row_key",
        F.col("at.binlog_file").alias("binlog_file"), F.col("at.binlog_pos").alias("binlog_pos"), F.col("at.row_no").alias("row_no"),
    )
