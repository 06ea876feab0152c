"""Evidence segments: admission, assignment, order, hash chain, manifests.

Events need: db_id, arrival, envelope_id, event_hash, and for the order inside
a segment commit_iso, gtid, binlog_file, binlog_pos, epoch_id, schema_name,
object_name, key_hash; for summaries state, reason, gap_detected, offset_key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators.ordered import fold, numbered

MAX_EVENTS, MAX_AGE_MS = 512, 300_000
ARRIVAL_BLOCK = 65_536


def rejected(events: DataFrame) -> Column:
    """Why an event can't enter a segment; null if it can."""
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    return (
        F.when(empty("db_id"), "missing source.db_id").when(empty("envelope_id"), "missing envelope_id")
        .when(~C.is_hash_token(F.col("event_hash")), "missing/invalid evidence.event_hash")
        .when(F.col("state").isNull(), "missing fidelity.state").when(F.col("offset_key").isNull(), "missing completeness.consumed_offset_key")
    )


def assigned_by_count(events: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """Adds segment_sequence: every max_events arrivals of a database make a segment."""
    df = events.withColumn("_block", F.floor(F.col("arrival") / ARRIVAL_BLOCK).cast("bigint"))
    df = numbered(df, ["db_id"], "_block", ["arrival"], "_n")
    return df.withColumn("segment_sequence", F.floor(F.col("_n") / max_events).cast("bigint")).drop("_n", "_block")


def assigned(events: DataFrame, max_events: int = MAX_EVENTS, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Adds segment_sequence and trigger by count and age.

    A segment is closed by its max_events-th event, or when an event arrives
    max_age_ms or more after the segment opened; that event opens the next. The
    age runs from the opening, so this is a fold. Needs at_ms, the time of arrival.
    """

    def step(state, row):
        at = row[2]
        if state is None:
            sequence, opened, n = 0, at, 0
        else:
            sequence, opened, n = state
            if n >= max_events or (n > 0 and at - opened >= max_age_ms):
                sequence, opened, n = sequence + 1, at, 0
        return (sequence, opened, n + 1), (sequence, opened, n)

    got = fold(events, "db_id", ["arrival"], ["at_ms"], "segment_sequence bigint, opened_ms bigint, nth int", step)
    return events.join(got, ["db_id", "arrival"])


def order_key() -> Column:
    """The frozen order of events: commit time, offset number, offset text, epoch (none last), object, row, id; text by code point."""
    by_gtid = F.col("gtid") != ""
    file = F.concat("binlog_file", F.lit(":"), F.coalesce("binlog_pos", F.lit(0)).cast("string"))
    number = F.when(by_gtid, F.coalesce(F.regexp_extract("gtid", r"(\d+)(?:-\d+)?$", 1).try_cast("bigint"), F.lit(0))).when(F.col("binlog_file").isNotNull(), F.coalesce("binlog_pos", F.lit(0))).otherwise(0)
    text = F.when(by_gtid, F.col("gtid")).when(F.col("binlog_file").isNotNull(), file).otherwise("")
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    return F.struct(
        F.col("commit_iso").alias("a"), number.cast("bigint").alias("b"), text.alias("c"), F.col("epoch_id").isNull().alias("d"), blank("epoch_id").alias("e"),
        blank("schema_name").alias("f"), blank("object_name").alias("g"), blank("key_hash").alias("h"), F.col("envelope_id").alias("i"),
    )


def sequenced(events: DataFrame) -> DataFrame:
    """Adds segment_id and seq, the place in the segment's order. A segment is bounded, so the window is."""
    order = Window.partitionBy("db_id", "segment_sequence").orderBy(order_key())
    return events.withColumn("segment_id", F.concat(F.lit("seg-"), F.lpad(F.col("segment_sequence").cast("string"), 6, "0"))).withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))


def chained(events: DataFrame) -> DataFrame:
    """Adds prev_row_hash and row_hash: each row's hash is over the previous row's and its own event hash, along a database's segments."""

    def step(state, row):
        previous = state or C.GENESIS
        own = "sha256:" + hashlib.sha256((previous + row[3]).encode()).hexdigest()
        return own, (previous, own)

    got = fold(events, "db_id", ["segment_sequence", "seq"], ["event_hash"], "prev_row_hash string, row_hash string", step)
    return events.join(got, ["db_id", "segment_sequence", "seq"])


def manifests(objects: DataFrame) -> DataFrame:
    """One row per segment: counts, ends, lists, offset range, summaries, manifest_hash of the canonical core."""
    each = F.struct("seq", "envelope_id", "event_hash", "row_hash", "prev_row_hash", "offset_key")
    # groups are segments, at most max_events objects
    m = objects.groupBy("db_id", "segment_sequence", "segment_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_list(each)).alias("objects"),
        F.count_if(F.col("state") == "DEGRADED").alias("degraded_count"), F.count_if(F.col("state") == "COMPROMISED").alias("compromised_count"),
        F.array_sort(F.collect_set(F.when(F.col("state") != "HEALTHY", F.col("reason")))).alias("reasons"), F.bool_or(F.coalesce("gap_detected", F.lit(False))).alias("gap_detected"),
    )
    first, last = F.element_at("objects", 1), F.element_at("objects", -1)
    m = m.select(
        "*", first["envelope_id"].alias("first_envelope_id"), last["envelope_id"].alias("last_envelope_id"), first["row_hash"].alias("first_row_hash"), last["row_hash"].alias("last_row_hash"),
        first["prev_row_hash"].alias("first_prev_row_hash"), first["offset_key"].alias("first_offset_key"), last["offset_key"].alias("last_offset_key"),
    )
    return m.withColumn("manifest_hash", C.sha(manifest_text()))


def manifest_text() -> Column:
    """The canonical core of a manifest, as writer and verifier hash it."""
    key = lambda o: C.object_key(F.col("db_id"), F.col("segment_id"), o["seq"], "cce")
    refs = F.transform("objects", lambda o: C.obj({"seq": o["seq"].cast("string"), "object_id": C.token(o["envelope_id"]), "worm_object_key": C.token(key(o)), "object_type": F.lit('"cce"')}))
    hashes = F.transform("objects", lambda o: C.obj({"seq": o["seq"].cast("string"), "event_hash": C.token(o["event_hash"]), "row_hash": C.token(o["row_hash"])}))
    yes = lambda c: c.cast("string")
    return C.obj({
        "segment_id": C.token(F.col("segment_id")), "db_id": C.token(F.col("db_id")), "segment_sequence": yes(F.col("segment_sequence")), "event_count": yes(F.col("event_count")),
        "first_envelope_id": C.token(F.col("first_envelope_id")), "last_envelope_id": C.token(F.col("last_envelope_id")), "first_row_hash": C.token(F.col("first_row_hash")), "last_row_hash": C.token(F.col("last_row_hash")),
        "object_list": C.arr(refs), "object_hash_list": C.arr(hashes),
        "source_offset_range": C.obj({"first_offset_key": C.token(F.col("first_offset_key")), "last_offset_key": C.token(F.col("last_offset_key"))}),
        "fidelity_summary": C.obj({"all_healthy": yes((F.col("degraded_count") + F.col("compromised_count")) == 0), "degraded_count": yes(F.col("degraded_count")), "compromised_count": yes(F.col("compromised_count")), "reasons": C.arr(F.transform("reasons", lambda r: C.token(r)))}),
        "completeness_summary": C.obj({"gap_detected": yes(F.col("gap_detected")), "expected_continuous": yes(~F.col("gap_detected")), "notes": F.lit("[]")}),
    })


def heads(m: DataFrame) -> DataFrame:
    """Adds the previous segment's id, number and hash (null, null and the genesis token at first) and segment_hash, linked along each database's segments."""

    def step(state, row):
        before_id, before_no, previous = state or (None, None, C.GENESIS)
        own = "sha256:" + hashlib.sha256((row[2] + row[3] + previous).encode()).hexdigest()
        return (row[4], row[1], own), (before_id, before_no, previous, own)

    got = fold(m, "db_id", ["segment_sequence"], ["manifest_hash", "last_row_hash", "segment_id"], "previous_segment_id string, previous_segment_sequence bigint, previous_segment_hash string, segment_hash string", step)
    return m.join(got, ["db_id", "segment_sequence"])


def sealed(objects: DataFrame) -> DataFrame:
    """Sealing as one step that fails closed: the segments' heads with ``status`` (SEALED or REFUSED) and ``problems``.

    What was chained is verified before it is sealed: each segment's objects by
    their rules, its manifest by its own lists, its head by the one before it. A
    segment with a problem is refused, and so is each later one of its database,
    as it would rest on it.
    """
    from lodeline.operators import verify

    found = heads(manifests(objects))
    broken = verify.object_failures(objects).select("db_id", "segment_sequence", "rule").unionByName(verify.manifest_failures(found)).unionByName(verify.cross_failures(found))
    bad = broken.groupBy("db_id", "segment_sequence").agg(F.array_sort(F.collect_set("rule")).alias("problems"))
    first = bad.groupBy("db_id").agg(F.min("segment_sequence").alias("_first"))
    out = found.join(bad, ["db_id", "segment_sequence"], "left").join(first, "db_id", "left")
    status = F.when(F.col("_first").isNotNull() & (F.col("segment_sequence") >= F.col("_first")), "REFUSED").otherwise("SEALED")
    return out.withColumn("status", status).withColumn("problems", F.coalesce("problems", F.array().cast("array<string>"))).drop("_first")
