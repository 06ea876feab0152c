"""Anchoring of segment heads: payloads, outcomes, records, cadence, open windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators.ordered import fold

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"

#: What is signed is this tag, a colon and the canonical payload; a verifier of other records passes their tag.
DOMAIN = "anchor-payload-v1"

#: The members of the payload; so are the statuses, answers and reasons in ``outcome``.
PAYLOAD = ("db_id", "segment_id", "segment_sequence", "segment_hash", "last_row_hash", "head_count", "created_at")


def payload_problem() -> Column:
    """Why a head isn't a valid payload; null if it is."""
    bad = lambda name: ~C.is_hash_token(F.col(name))
    instant = F.coalesce(F.col("created_at").rlike(RFC3339) & F.try_to_timestamp("created_at").isNotNull(), F.lit(False))
    return (
        F.when(F.coalesce("db_id", F.lit("")) == "", "db_id").when(F.coalesce("segment_id", F.lit("")) == "", "segment_id").when(F.coalesce("segment_sequence", F.lit(-1)) < 0, "segment_sequence")
        .when(bad("segment_hash"), "segment_hash").when(bad("last_row_hash"), "last_row_hash").when(F.coalesce("head_count", F.lit(0)) < 1, "head_count").when(~instant, "created_at")
    )


def payload_members(text: Column) -> Column:
    """Why payload text hasn't exactly the payload's members (missing:name or unknown:name, the first by name); null if it has, ``unreadable`` for what isn't an object."""
    names = F.json_object_keys(text)
    known = F.array(*[F.lit(n) for n in sorted(PAYLOAD)])
    first = lambda kind, left: F.concat(F.lit(f"{kind}:"), F.array_min(left))
    missing, unknown = F.array_except(known, names), F.array_except(names, known)
    return F.when(names.isNull(), "unreadable").when(F.size(missing) > 0, first("missing", missing)).when(F.size(unknown) > 0, first("unknown", unknown))


def payload_text() -> Column:
    number = ("segment_sequence", "head_count")
    return C.obj({n: C.token(F.col(n), "number" if n in number else "string") for n in PAYLOAD})


def payload_hash(domain: str = DOMAIN) -> Column:
    return C.sha(signing_message(domain))


def signing_message(domain: str = DOMAIN) -> Column:
    return F.concat(F.lit(domain + ":"), payload_text())


def outcome(answers: DataFrame) -> DataFrame:
    """Adds status (anchored, pending, failed) and why.

    answers: provider_type, answer (anchored, outage, timeout, ...), token,
    answered_hash, payload_hash, verified. Anchored needs a token of the provider's
    form (base64 of a time stamp, an inclusion proof's members), the requested hash and a verified token; outage and timeout are pending; all else failed.
    """
    member = lambda name: F.get_json_object("token", f"$.{name}")
    log = (F.length(member("log_id")) > 0) & member("leaf_index").rlike(r"^\d+$") & member("inclusion_proof").startswith("[") & (F.length(member("signed_tree_head")) > 0)
    shape = F.when(F.col("provider_type") == "rfc3161", F.col("token").rlike(r"^[A-Za-z0-9+/]+=*$")).when(F.col("provider_type") == "transparency_log", log).otherwise(F.length("token") > 0)
    formed = F.coalesce(shape, F.lit(False))
    bound = F.col("answered_hash").eqNullSafe(F.col("payload_hash"))
    known = F.col("provider_type").isin("rfc3161", "transparency_log", "dual_custodian")
    why = (
        F.when(~known, "unknown_provider").when(F.col("answer") == "outage", "provider_error").when(F.col("answer") == "timeout", "timeout").when(F.col("answer") != "anchored", "rejected")
        .when(~formed, "malformed").when(~bound, "wrong_hash").when(~F.coalesce("verified", F.lit(False)), "not_verified")
    )
    status = F.when(why.isNull() & F.col("answer").isNotNull(), "anchored").when(known & F.col("answer").isin("outage", "timeout"), "pending").otherwise("failed")
    return answers.withColumn("status", status).withColumn("why", why)


def records(anchored: DataFrame) -> DataFrame:
    """One record for each anchor_id: the earliest; collision tells whether other heads were bound to the id."""
    df = anchored.where("status = 'anchored'").withColumn("anchor_id", C.anchor_id(F.col("payload_hash"), F.col("provider_type")))
    return df.groupBy("anchor_id").agg(F.min_by(F.struct("payload_hash", "provider_type", "token", "created_at"), F.struct("created_at", "token")).alias("r"), (F.min("payload_hash") != F.max("payload_hash")).alias("collision"), (F.count(F.lit(1)) - 1).alias("deduplicated")).select("anchor_id", "r.*", "collision", "deduplicated")


def due(events: DataFrame, max_events: int, max_interval_ms: int) -> DataFrame:
    """Events at which a database's head must be anchored: db_id, arrival, reason (events or interval).

    Counted since the last anchor, timed from the first event or the last anchor; a fold. Needs at_ms.
    """

    def step(state, row):
        n, last = state or (0, row[2])
        n += 1
        reason = "events" if n >= max_events else "interval" if row[2] - last >= max_interval_ms else None
        return ((0, row[2]) if reason else (n, last)), (reason,)

    return fold(events, "db_id", ["arrival"], ["at_ms"], "reason string", step).where(F.col("reason").isNotNull())


def open_window(sealed: DataFrame, anchored: DataFrame, now_ms: int, max_window_ms: int) -> DataFrame:
    """Age and severity of the oldest head of each database that isn't anchored: none, warning (>1x), critical (>2x), emergency (>4x)."""
    waiting = sealed.join(anchored.select("db_id", "segment_id"), ["db_id", "segment_id"], "left_anti")
    age = F.lit(now_ms) - F.col("oldest_ms")
    severity = F.when(age <= max_window_ms, "none").when(age <= 2 * max_window_ms, "warning").when(age <= 4 * max_window_ms, "critical").otherwise("emergency")
    return waiting.groupBy("db_id").agg(F.min("sealed_ms").alias("oldest_ms"), F.count(F.lit(1)).alias("pending")).withColumn("age_ms", age).withColumn("severity", severity)
