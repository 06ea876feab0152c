"""Verification of sealed segments: nothing is trusted that can be computed again.

Checks are independent of each other and parallel over objects and segments; a
check without data is SKIPPED, and what isn't PASS is no PASS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import canonical as C

#: The checks; all but the last are required.
CHECKS = ("per_object_hash", "object_chain", "segment_manifest", "cross_segment_continuity", "no_missing_segment", "no_missing_event", "hsm_signature", "anchor_token", "projection_consistency")
REQUIRED = CHECKS[:-1]


def object_failures(objects: DataFrame) -> DataFrame:
    """(db_id, segment_sequence, seq, envelope_id, rule) of each broken rule of an object.

    EVENT_HASH: the hash of core isn't event_hash; ROW_HASH: that of the previous
    token and event_hash isn't row_hash; PREV_LINK: prev_row_hash isn't the row
    hash before it in its segment; ORDER: places aren't 0, 1, ... Looking back
    stays inside a segment, which is bounded.
    """
    order = Window.partitionBy("db_id", "segment_sequence").orderBy("seq", "envelope_id")
    df = objects.select("*", F.lag("row_hash").over(order).alias("_prev"), (F.row_number().over(order) - 1).alias("_n"))
    event_ok = F.col("event_hash").eqNullSafe(C.sha(F.col("core")))
    rule = lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array(
        rule(F.col("seq") != F.col("_n"), "ORDER"), rule(~event_ok, "EVENT_HASH"), rule(~F.col("row_hash").eqNullSafe(C.row_hash(F.col("prev_row_hash"), F.col("event_hash"))), "ROW_HASH"),
        rule((F.col("_n") > 0) & ~F.col("prev_row_hash").eqNullSafe(F.col("_prev")), "PREV_LINK"),
    )
    return df.select("db_id", "segment_sequence", "seq", "envelope_id", F.explode(F.array_compact(rules)).alias("rule"))


def list_failures(objects: DataFrame, manifests: DataFrame) -> DataFrame:
    """Objects that differ from their manifest's lists: HASH_LIST, ORDER (misplaced), MISSING (listed only), EXTRA (not listed)."""
    listed = manifests.select("db_id", "segment_sequence", F.posexplode("objects").alias("_i", "o")).select(
        "db_id", "segment_sequence", F.col("_i").cast("bigint").alias("seq"), F.col("o.envelope_id").alias("l_id"), F.col("o.event_hash").alias("l_event"), F.col("o.row_hash").alias("l_row"), F.col("o.seq").alias("l_seq")
    )
    df = objects.select("db_id", "segment_sequence", "seq", "envelope_id", "event_hash", "row_hash").join(listed, ["db_id", "segment_sequence", "seq"], "full_outer")
    rules = F.array(
        F.when(F.col("envelope_id").isNull(), "MISSING"), F.when(F.col("l_id").isNull(), "EXTRA"),
        F.when((F.col("envelope_id") != F.col("l_id")) | (F.col("l_seq") != F.col("seq")), "ORDER"), F.when((F.col("event_hash") != F.col("l_event")) | (F.col("row_hash") != F.col("l_row")), "HASH_LIST"),
    )
    return df.select("db_id", "segment_sequence", "seq", F.coalesce("envelope_id", "l_id").alias("envelope_id"), F.explode(F.array_compact(rules)).alias("rule"))


def manifest_failures(manifests: DataFrame) -> DataFrame:
    """(db_id, segment_sequence, rule) of what a manifest says against itself.

    MANIFEST_HASH: its hash isn't that of its canonical core; EVENT_COUNT: its
    count isn't its lists' length; LIST_INDEX: places in a list aren't 0, 1, ...;
    ENDPOINTS: its first or last ids or hashes aren't those of its lists.
    """
    from lodeline.operators.segments import manifest_text

    first, last = F.try_element_at("objects", F.lit(1)), F.try_element_at("objects", F.lit(-1))
    ends = F.lit(False)
    for name in ("envelope_id", "row_hash"):
        ends = ends | ~F.col(f"first_{name}").eqNullSafe(first[name]) | ~F.col(f"last_{name}").eqNullSafe(last[name])
    index = F.exists(F.transform("objects", lambda o, i: o["seq"] != i), lambda x: x)
    rules = F.array(
        F.when(~F.col("manifest_hash").eqNullSafe(C.sha(manifest_text())), "MANIFEST_HASH"), F.when(~F.col("event_count").eqNullSafe(F.size("objects").cast("bigint")), "EVENT_COUNT"),
        F.when(F.coalesce(index, F.lit(True)), "LIST_INDEX"), F.when(ends, "ENDPOINTS"),
    )
    return manifests.select("db_id", "segment_sequence", F.explode(F.array_compact(rules)).alias("rule"))


_LINK = ("db_id", "segment_id", "segment_sequence", "manifest_hash", "last_row_hash", "previous_segment_hash")


def link_failures(pairs: DataFrame) -> DataFrame:
    """Rows of ``pairs`` with each rule (column rule) their link breaks.

    pairs: a segment's head and, as columns named p_..., the manifest supplied as
    the one before it (null if none). GENESIS: the first segment has a
    predecessor or names one; MISSING_PREVIOUS; DB_ID; SEQUENCE; PREVIOUS_SEGMENT:
    it names no predecessor or another; PREVIOUS_SEGMENT_HASH: not the hash
    computed again; ROW_BOUNDARY: the chain of rows breaks between the two.
    """
    col = F.col
    genesis, there = col("segment_sequence") == 0, col("p_manifest_hash").isNotNull()
    named = col("previous_segment_id").isNotNull() | col("previous_segment_sequence").isNotNull() | (col("previous_segment_hash") != C.GENESIS)
    later = ~genesis & there
    differs = lambda a, b: ~a.eqNullSafe(b)
    rules = F.array(
        F.when(genesis & (there | F.coalesce(named, F.lit(True))), "GENESIS"), F.when(~genesis & ~there, "MISSING_PREVIOUS"),
        F.when(later & differs(col("db_id"), col("p_db_id")), "DB_ID"), F.when(later & differs(col("segment_sequence"), col("p_segment_sequence") + 1), "SEQUENCE"),
        F.when(later & (differs(col("previous_segment_id"), col("p_segment_id")) | differs(col("previous_segment_sequence"), col("p_segment_sequence"))), "PREVIOUS_SEGMENT"),
        F.when(later & differs(col("previous_segment_hash"), C.sha(F.concat("p_manifest_hash", "p_last_row_hash", "p_previous_segment_hash"))), "PREVIOUS_SEGMENT_HASH"),
        F.when(later & differs(col("first_prev_row_hash"), col("p_last_row_hash")), "ROW_BOUNDARY"),
    )
    return pairs.withColumn("rule", F.explode(F.array_compact(rules)))


def cross_failures(heads: DataFrame) -> DataFrame:
    """(db_id, segment_sequence, rule) of each broken link between a segment and the one before it by number.

    A self-join on the number, not on neighbours, so a gap shows as MISSING_PREVIOUS.
    """
    before = heads.select(*[F.col(c).alias(f"p_{c}") for c in _LINK])
    df = heads.join(before, (F.col("db_id") == F.col("p_db_id")) & (F.col("segment_sequence") == F.col("p_segment_sequence") + 1), "left")
    return link_failures(df).select("db_id", "segment_sequence", "rule")


def anchor_failures(heads: DataFrame, records: DataFrame, keys: DataFrame, certificates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failures of the heads' signatures, failures of the anchors' tokens): db_id, segment_sequence, problem.

    heads are recomputed. records, of each segment the earliest: db_id and the
    members of the anchored payload, signing_key_id, algorithm, signature,
    provider_type, token, cert_ref. keys: key_id, algorithm, public_key,
    created_ms, revoked_ms; certificates: ref, algorithm, public_key. A segment
    without a record fails both. The record must be of the recomputed head, its
    key known, active when it signed and of the stated algorithm; the token must
    hold against the trusted certificate and be of the payload.
    """
    from lodeline.functions.ed25519 import verified
    from lodeline.functions.proofs import token_problem
    from lodeline.operators import anchor

    rest = [c for c in records.columns if c not in ("db_id", "segment_id")]
    one = records.groupBy("db_id", "segment_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "signature", "token")).alias("r"))
    own = heads.select("db_id", "segment_id", F.col("segment_sequence").alias("h_sequence"), C.sha(F.concat("manifest_hash", "last_row_hash", "previous_segment_hash")).alias("h_hash"), F.col("last_row_hash").alias("h_last"))
    df = own.join(one, ["db_id", "segment_id"], "left").select("*", "r.*", F.col("r").isNotNull().alias("has")).drop("r")
    df = df.withColumn("payload_problem", anchor.payload_problem()).withColumn("message", anchor.signing_message()).withColumn("payload_hash", anchor.payload_hash())
    signed_ms = F.unix_millis(F.try_to_timestamp("created_at"))
    df = key_state(df.withColumn("key_id", F.col("signing_key_id")).withColumn("at_ms", signed_ms), keys)
    known = keys.groupBy("key_id").agg(F.min_by(F.struct(F.col("algorithm").alias("k_algorithm"), F.col("public_key").alias("k_public")), F.struct("created_ms", "revoked_ms")).alias("k"))
    trusted = certificates.groupBy("ref").agg(F.min_by(F.struct(F.col("algorithm").alias("c_algorithm"), F.col("public_key").alias("c_public")), F.struct("algorithm", "public_key")).alias("c"))
    df = df.join(known, "key_id", "left").join(trusted, F.col("cert_ref") == F.col("ref"), "left")
    df = df.withColumn("_signed", verified(F.col("k.k_public"), F.col("message"), F.col("signature")))
    df = df.withColumn("_token", token_problem("provider_type", "token", "payload_hash", "ref", F.col("c.c_public"), F.col("c.c_algorithm")))
    form = F.when(~F.col("has"), "no_record").when(F.col("payload_problem").isNotNull(), F.concat(F.lit("payload:"), "payload_problem"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    signature = (
        form.when(differs("segment_hash", "h_hash"), "segment_hash").when(differs("last_row_hash", "h_last"), "last_row_hash").when(differs("segment_sequence", "h_sequence"), "segment_sequence")
        .when(F.col("key_state") != "active", F.col("key_state")).when(differs("algorithm", "k.k_algorithm") | (F.col("algorithm") != "ed25519"), "algorithm").when(~F.col("_signed"), "signature")
    )
    out = lambda problem: df.select("db_id", F.col("h_sequence").alias("segment_sequence"), problem.alias("problem")).where(F.col("problem").isNotNull())
    return out(signature), out(form.otherwise(F.col("_token")))


def segment_gaps(manifests: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(db_id, segment_sequence, problem): missing, duplicate or outside, against a scope (db_id, first, last) or the numbers' own range.

    Holes are the steps between neighbouring numbers, so a wide gap costs what it reports.
    """
    counts = manifests.groupBy("db_id", "segment_sequence").agg(F.count(F.lit(1)).alias("n"))
    if scope is None:
        scope = counts.groupBy("db_id").agg(F.min("segment_sequence").alias("first"), F.max("segment_sequence").alias("last"))
    order = Window.partitionBy("db_id").orderBy("segment_sequence")
    ends = scope.select("db_id", F.explode(F.array(F.col("first") - 1, F.col("last") + 1)).alias("segment_sequence"), F.lit(0).cast("bigint").alias("n"))
    inside = counts.join(scope, "db_id").where(F.col("segment_sequence").between(F.col("first"), F.col("last"))).select("db_id", "segment_sequence", "n")
    steps = inside.unionByName(ends).select("*", F.lag("segment_sequence").over(order).alias("p")).where(F.col("segment_sequence") - F.col("p") > 1)
    missing = steps.select("db_id", F.explode(F.sequence(F.col("p") + 1, F.col("segment_sequence") - 1)).alias("segment_sequence"), F.lit("missing").alias("problem"))
    duplicate = counts.where("n > 1").select("db_id", "segment_sequence", F.lit("duplicate").alias("problem"))
    outside = counts.join(scope, "db_id").where(~F.col("segment_sequence").between(F.col("first"), F.col("last"))).select("db_id", "segment_sequence", F.lit("outside").alias("problem"))
    return missing.unionByName(duplicate).unionByName(outside)


def event_gaps(manifests: DataFrame) -> DataFrame:
    """(db_id, segment_sequence, problem): gap flags, offset ends that aren't those of the objects, offsets used again."""
    order = Window.partitionBy("db_id").orderBy("segment_sequence")
    df = manifests.select("*", F.lag("last_offset_key").over(order).alias("_prev"))
    problems = F.array(
        F.when(F.col("gap_detected"), "gap_detected"), F.when(~F.col("first_offset_key").eqNullSafe(F.element_at("objects", 1)["offset_key"]), "first_offset_key"),
        F.when(~F.col("last_offset_key").eqNullSafe(F.element_at("objects", -1)["offset_key"]), "last_offset_key"), F.when(F.col("first_offset_key") == F.col("_prev"), "offset_overlap"),
    )
    return df.select("db_id", "segment_sequence", F.explode(F.array_compact(problems)).alias("problem"))


def projection_drift(objects: DataFrame, projection: DataFrame) -> DataFrame:
    """(object_id, problem): rows of the projection that drifted, are extra or missing; with db_id where both sides have it."""
    on = ["db_id", "object_id"] if "db_id" in objects.columns and "db_id" in projection.columns else ["object_id"]
    a = objects.withColumn("object_id", F.col("envelope_id")).select(*on, F.col("row_hash").alias("sealed"))
    df = a.join(projection.select(*on, F.col("row_hash").alias("shown")), on, "full_outer")
    problem = F.when(F.col("sealed").isNull(), "extra row").when(F.col("shown").isNull(), "missing row").when(F.col("sealed") != F.col("shown"), "drifted")
    return df.select(*on, problem.alias("problem")).where(F.col("problem").isNotNull())


def report(databases: DataFrame, checks: dict[str, DataFrame | None]) -> DataFrame:
    """One row per database and check: result, failures and, on every row, the overall verdict.

    checks: for each name the failures with their db_id, or None if it wasn't
    made. Overall is PASS only if every required check is PASS.
    """
    rows = None
    for name in CHECKS:
        found = checks.get(name)
        if found is None:
            one = databases.select("db_id", F.lit(name).alias("check"), F.lit("SKIPPED").alias("result"), F.lit(0).cast("bigint").alias("failures"))
        else:
            n = found.groupBy("db_id").agg(F.count(F.lit(1)).alias("failures"))
            one = databases.select("db_id").join(n, "db_id", "left").select("db_id", F.lit(name).alias("check"), F.when(F.col("failures").isNull(), "PASS").otherwise("FAIL").alias("result"), F.coalesce("failures", F.lit(0)).alias("failures"))
        rows = one if rows is None else rows.unionByName(one)
    passed = F.count_if(F.col("check").isin(*REQUIRED) & (F.col("result") == "PASS")).over(Window.partitionBy("db_id"))
    return rows.withColumn("overall", F.when(passed == len(REQUIRED), "PASS").otherwise("FAIL"))


def offending(checks: dict[str, DataFrame | None], ids: list[str]) -> DataFrame:
    """Each distinct thing a check failed on: db_id, check, id (the columns named in ids that the check's failures have, joined by ``/``)."""
    rows = None
    for name, found in checks.items():
        if found is None:
            continue
        parts = [F.col(c).cast("string") for c in ids if c in found.columns]
        one = found.select("db_id", F.lit(name).alias("check"), F.concat_ws("/", *parts).alias("id")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows


def exportable(selected: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coverage of an export: (selected objects in no supplied segment, gaps of the supplied segments from 0 on)."""
    held = manifests.select("db_id", F.explode("objects").alias("o")).select("db_id", F.col("o.envelope_id").alias("envelope_id"))
    scope = manifests.groupBy("db_id").agg(F.lit(0).cast("bigint").alias("first"), F.max("segment_sequence").alias("last"))
    return selected.join(held, ["db_id", "envelope_id"], "left_anti"), segment_gaps(manifests, scope)


def key_state(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds key_state to uses (key_id, at_ms): unknown, not_yet_valid, revoked (from revoked_ms on) or active. Of keys with one id the earliest created counts."""
    one = keys.groupBy("key_id").agg(F.min_by(F.struct("created_ms", "revoked_ms"), F.struct("created_ms", "revoked_ms")).alias("k"))
    df = uses.join(one, "key_id", "left")
    state = F.when(F.col("k").isNull(), "unknown").when(F.col("at_ms") < F.col("k.created_ms"), "not_yet_valid").when(F.col("at_ms") >= F.col("k.revoked_ms"), "revoked").otherwise("active")
    return df.withColumn("key_state", state).drop("k")


def signature_failures(signed: DataFrame, keys: DataFrame) -> DataFrame:
    """Signatures that don't hold: the rows of ``signed`` with ``problem``.

    signed: key_id, algorithm, message, signature (base64), at_ms. keys: key_id,
    public_key, created_ms, revoked_ms. Problems: the key's state unless active,
    another algorithm than ed25519, a signature that doesn't verify.
    """
    from lodeline.functions.ed25519 import verified

    known = keys.groupBy("key_id").agg(F.min_by("public_key", F.struct("created_ms", "revoked_ms")).alias("public_key"))
    df = key_state(signed, keys).join(known, "key_id", "left").withColumn("_ok", verified(F.col("public_key"), F.col("message"), F.col("signature")))
    problem = F.when(F.col("key_state") != "active", F.col("key_state")).when(F.lower("algorithm") != "ed25519", "algorithm").when(~F.col("_ok"), "signature")
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_ok", "public_key", "key_state")
