"""Dead letters: classification, identity, upsert, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import canonical as C

MAX_RETRIES = 5

#: Categories with the patterns that infer them, in the order they are tried, and the one that is retried.
PATTERNS = (
    ("MALFORMED_CDC_EVENT", "json|parse|malformed|unexpected token"),
    ("UNSUPPORTED_ENGINE", "unsupported engine|unknown engine|no adapter"),
    ("SCHEMA_VALIDATION_FAILURE", r"schema|validation|invalid cce|rule v\d"),
    ("OFFSET_CORRUPTION", "offset|gtid corrupt|corrupt offset"),
    ("SERIALIZATION_FAILURE", "serializ"),
)
RETRYABLE = ("UNEXPECTED_EXCEPTION",)


def category(reason: Column, given: Column | None = None) -> Column:
    """The given category, else the first whose pattern the message has; any other message is unexpected, none is unclassified."""
    text = F.lower(reason)
    out = F.when(text.rlike(PATTERNS[0][1]), PATTERNS[0][0])
    for name, pattern in PATTERNS[1:]:
        out = out.when(text.rlike(pattern), name)
    out = out.when(reason.isNotNull(), "UNEXPECTED_EXCEPTION").otherwise("UNCLASSIFIED")
    return out if given is None else F.coalesce(given, out)


def status(category_: Column, retryable: Column, retries: Column, most: int = MAX_RETRIES) -> Column:
    stop = (category_ == "UNCLASSIFIED") | ~retryable | (retries >= most)
    return F.when(stop, "quarantined").otherwise("retryable")


def event_id(engine: Column, offset_key: Column, payload_hash: Column) -> Column:
    return F.concat(F.lit("dlq-"), F.substring(F.sha2(F.concat_ws("|", engine, F.coalesce(offset_key, F.lit("")), payload_hash), 256), 1, 32))


def records(failures: DataFrame) -> DataFrame:
    """Failures (source_engine, offset_key, failure_reason, payload, at) as dead letters with category, hash and id."""
    kind = category(F.col("failure_reason"))
    df = failures.withColumn("failure_category", kind).withColumn("retryable", kind.isin(*RETRYABLE)).withColumn("payload_hash", C.sha(C.stable(F.col("payload"))))
    return df.withColumn("event_id", event_id(F.col("source_engine"), F.col("offset_key"), F.col("payload_hash")))


def upserted(items: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """One item for each event_id: retry_count counts the repeats, the last occurrence says the rest.

    Items: event_id, failure_category, retryable, seen, and a unique tie-break delivery_id.
    """
    latest = F.struct("seen", "delivery_id")
    one = items.groupBy("event_id").agg(
        (F.count(F.lit(1)) - 1).alias("retry_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.max_by(F.struct("failure_category", "retryable"), latest).alias("x"),
    )
    return one.select("event_id", "x.failure_category", "x.retryable", "retry_count", status(F.col("x.failure_category"), F.col("x.retryable"), F.col("retry_count"), most).alias("status"), "first_seen", "last_seen")


def metrics(items: DataFrame) -> DataFrame:
    """Depth, by category and status and in total, and occurrences: one pass with a rollup. Null labels are totals."""
    return items.rollup("failure_category", "status").agg(F.count(F.lit(1)).alias("depth"), F.sum(F.col("retry_count") + 1).alias("occurrences"))


def depth_alarm(items: DataFrame, threshold: int) -> DataFrame:
    """One row if there are more items than the threshold: high if any is quarantined."""
    total = items.agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    return total.where(F.col("depth") > threshold).withColumn("severity", F.when(F.col("quarantined") > 0, "high").otherwise("medium"))


def newest(items: DataFrame, n: int, **equal: str) -> DataFrame:
    """The newest n items of those with equal status, category or engine."""
    for column, value in equal.items():
        items = items.where(F.col(column) == value)
    return items.orderBy(F.desc("last_seen"), F.desc("delivery_id")).limit(n)
