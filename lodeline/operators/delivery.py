"""Problem 4: messages delivered more than once.

Hash aggregation by the item's identifier with min_by over a struct of delivery
time and a deterministic tie-break. Partial aggregation collapses each map
task's repeats before the shuffle, so an item that holds a third of all
deliveries arrives as one row per map task. The repeats are then the deliveries
whose id isn't kept: an anti-join on the unique delivery_id, which can't be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_identity(stream_id: Column) -> Column:
    """``ms-seq`` without blanks and leading zeros; a missing seq is 0.

    Text of any other form stays as it is, without blanks. Null stays null, and
    text of blanks alone is null.
    """
    bare = F.nullif(F.regexp_replace(stream_id, r"\s+", ""), F.lit(""))
    form = r"^0*(\d+)(?:-0*(\d+))?$"
    seq = F.regexp_extract(bare, form, 2)
    return F.when(bare.rlike(form), F.concat(F.regexp_extract(bare, form, 1), F.lit("-"), F.when(seq == "", "0").otherwise(seq))).otherwise(bare)


def payload_identity(payload_hash: Column) -> Column:
    """``sha256:`` and 64 lower-case hex digits."""
    return F.concat(F.lit("sha256:"), F.regexp_replace(F.regexp_replace(F.lower(payload_hash), r"\s+", ""), "^sha256:", ""))


def item_identity(event_id: Column, engine: Column, offset_key: Column, payload_hash: Column) -> Column:
    """``dlq-`` and 32 lower-case hex digits.

    A null or blank event_id is derived from source_engine|offset_key|payload_hash (null
    engine and offset as empty text). Null where payload_hash is null as well:
    such a delivery has no identity and is never a repeat.
    """
    bare = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(event_id), r"\s+", ""), "^dlq-", ""), F.lit(""))
    given = F.concat(F.lit("dlq-"), bare)
    text = F.concat(F.coalesce(engine, F.lit("")), F.lit("|"), F.coalesce(offset_key, F.lit("")), F.lit("|"), payload_identity(payload_hash))
    return F.coalesce(given, F.concat(F.lit("dlq-"), F.substring(F.sha2(text, 256), 1, 32)))


def kept(deliveries: DataFrame, item: list[str], best: Column, delivery: str = "delivery_id") -> DataFrame:
    """The delivery id kept of each item: that of the smallest ``best``."""
    return deliveries.groupBy(*item).agg(F.min_by(delivery, best).alias(delivery)).select(delivery)


def repeats(deliveries: DataFrame, item: list[str], best: Column, delivery: str = "delivery_id") -> DataFrame:
    """Ids of the deliveries that aren't kept. Rows whose item has a null in it must be filtered out before."""
    return deliveries.select(delivery).join(kept(deliveries, item, best, delivery), delivery, "left_anti")


def _raw_items(raw: DataFrame) -> tuple[DataFrame, list[str], Column]:
    items = raw.select("delivery_id", F.coalesce("topic", F.lit("")).alias("topic"), stream_identity(F.col("stream_id")).alias("item"), "received_at").where(F.col("item").isNotNull())
    # a null received_at counts as the latest
    return items, ["topic", "item"], F.struct(F.col("received_at").isNull().alias("n"), "received_at", "delivery_id")


def _dlq_items(dlq: DataFrame) -> tuple[DataFrame, list[str], Column]:
    items = dlq.select(
        "delivery_id",
        item_identity(F.col("event_id"), F.col("source_engine"), F.col("offset_key"), F.col("payload_hash")).alias("item"),
        F.unix_micros(F.col("last_seen").cast("timestamp")).alias("seen"),
    ).where(F.col("item").isNotNull())
    # the latest last_seen, then the largest id: the smallest of their negatives; a null last_seen counts as the earliest
    return items, ["item"], F.struct(F.col("seen").isNull().alias("n"), (-F.col("seen")).alias("s"), (-F.col("delivery_id")).alias("d"))


def once_raw(raw: DataFrame) -> DataFrame:
    """``raw_source_event`` with exactly one delivery of each item; null stream ids are all kept."""
    items, item, best = _raw_items(raw)
    return raw.join(repeats(items, item, best), "delivery_id", "left_anti")


def once_dlq(dlq: DataFrame) -> DataFrame:
    """``dlq`` with exactly one delivery of each item; deliveries without identity are all kept."""
    items, item, best = _dlq_items(dlq)
    return dlq.join(repeats(items, item, best), "delivery_id", "left_anti")


def p4_found(raw: DataFrame, dlq: DataFrame) -> DataFrame:
    """(source_table, delivery_id) of each delivery that isn't kept."""
    a, b = repeats(*_raw_items(raw)), repeats(*_dlq_items(dlq))
    return a.select(F.lit("raw_source_event").alias("source_table"), "delivery_id").unionByName(b.select(F.lit("dlq").alias("source_table"), "delivery_id"))
