"""Registry of signing keys under dual control, and the trust file made of it.

A registry is an append-only log of decisions; its state is a fold over them, as
whether a step is allowed depends on the steps before. Registries are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators.ordered import fold

#: Algorithms of keys.
ALGORITHMS = ("ecdsa-p256", "ecdsa-p384", "ed25519", "rsa-pss-3072")


def decided(steps: DataFrame) -> DataFrame:
    """Adds verdict (ACCEPTED or why not) and active (the registry's active key after the step).

    steps: registry, n (order), kind (register, rotate, revoke), key_id,
    algorithm, public_key, created_ms, revoked_ms, requested_by, approved_by.
    register founds the registry with its first active key or adds history;
    rotate brings in a new active key, revoke ends one that isn't active. Rotation
    and revocation need two persons. A refused step changes nothing.
    """

    def step(state, row):
        active, known = state or (None, {})
        _, _, kind, key, algorithm, public, created, revoked, asked, approved = row
        end = None if revoked is None or revoked != revoked else int(revoked)
        new = kind in ("register", "rotate")
        why = None
        if kind not in ("register", "rotate", "revoke"):
            why = "UNKNOWN_STEP"
        elif kind != "register" and not (asked and approved):
            why = "DUAL_CONTROL_MISSING"
        elif kind != "register" and asked == approved:
            why = "DUAL_CONTROL_SAME_PERSON"
        elif not key or (new and (algorithm not in ALGORITHMS or not public or created is None or created != created)):
            why = "INVALID_KEY"
        elif new and key in known:
            why = "KEY_EXISTS"
        elif new and end is not None and end < created:
            why = "REVOKED_BEFORE_CREATED"
        elif (kind == "rotate" or (kind == "register" and active is None)) and end is not None:
            why = "ACTIVE_KEY_REVOKED"
        elif kind == "revoke" and key not in known:
            why = "UNKNOWN_KEY"
        elif kind == "revoke" and key == active:
            why = "KEY_IS_ACTIVE"
        elif kind == "revoke" and known[key][1] is not None:
            why = "ALREADY_REVOKED"
        elif kind == "revoke" and (end is None or end < known[key][0]):
            why = "REVOKED_BEFORE_CREATED"
        if why is None:
            if new:
                known = {**known, key: (created, end)}
                active = key if kind == "rotate" or active is None else active
            else:
                known = {**known, key: (known[key][0], end)}
        return (active, known), (why or "ACCEPTED", active)

    columns = ["kind", "key_id", "algorithm", "public_key", "created_ms", "revoked_ms", "requested_by", "approved_by"]
    got = fold(steps, "registry", ["n"], columns, "verdict string, active string", step)
    return steps.join(got, ["registry", "n"])


def keys_of(decisions: DataFrame) -> DataFrame:
    """The keys of each registry, none ever dropped: registry, key_id, algorithm, public_key, created_ms, revoked_ms, active."""
    ok = decisions.where("verdict = 'ACCEPTED'")
    last = decisions.groupBy("registry").agg(F.max_by("active", "n").alias("_active"))
    born = ok.where("kind <> 'revoke'").select("registry", "key_id", "algorithm", "public_key", "created_ms", F.col("revoked_ms").alias("_from_birth"))
    ended = ok.where("kind = 'revoke'").select("registry", "key_id", F.col("revoked_ms").alias("_ended"))
    df = born.join(ended, ["registry", "key_id"], "left").join(last, "registry")
    return df.select("registry", "key_id", "algorithm", "public_key", "created_ms", F.coalesce("_ended", "_from_birth").alias("revoked_ms"), (F.col("key_id") == F.col("_active")).alias("active"))


def trust_file(signing: DataFrame, export: DataFrame, certificates: DataFrame, version: int, generated_at: str) -> DataFrame:
    """The trust file in one row: text (canonical), trust_hash, problem (null, or why there is none).

    signing and export: keys as ``keys_of`` gives them; certificates: ref,
    algorithm, public_key. Entries are sorted by id. Refused are certificates
    among the keys, a key id in both planes, malformed certificates, and a file
    without any entry.
    """
    def plane(keys: DataFrame, name: str) -> DataFrame:
        entry = C.obj({"key_id": C.token(F.col("key_id")), "algorithm": C.token(F.col("algorithm")), "public_key": C.token(F.col("public_key")), "not_before": C.token(C.iso_of_millis(F.col("created_ms"))), "revoked_at": C.token(C.iso_of_millis(F.col("revoked_ms")))})
        return keys.agg(
            F.array_sort(F.collect_list(F.struct("key_id", entry.alias("text")))).alias(name), F.max(F.when(F.col("active"), F.col("key_id"))).alias(f"{name}_active"),
            F.count_if(F.col("public_key").rlike("-----BEGIN[A-Z ]*CERTIFICATE-----")).alias(f"{name}_certs"),
        )

    entry = C.obj({n: C.token(F.col(n)) for n in ("ref", "algorithm", "public_key")})
    empty = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    certs = certificates.agg(F.array_sort(F.collect_list(F.struct("ref", entry.alias("text")))).alias("certs"), F.count_if(empty("ref") | empty("algorithm") | empty("public_key")).alias("malformed"))
    both = signing.select("key_id").join(export.select("key_id"), "key_id", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    # four aggregates of one row each
    df = plane(signing, "signing").join(plane(export, "export")).join(certs).join(both)
    problem = (
        F.when(F.lit(version < 1), "trust_version").when(F.try_to_timestamp(F.lit(generated_at)).isNull(), "generated_at").when((F.col("signing_certs") > 0) | (F.col("export_certs") > 0), "certificate_among_keys")
        .when(F.col("shared") > 0, "key_in_both_planes").when(F.col("malformed") > 0, "malformed_certificate").when(F.size("signing") + F.size("export") + F.size("certs") == 0, "empty")
    )
    texts = lambda name: C.arr(F.transform(name, lambda x: x["text"]))
    text = C.obj({
        "trust_version": F.lit(str(version)), "generated_at": C.token(F.lit(generated_at)), "active_signing_key_id": C.token(F.col("signing_active")), "active_export_key_id": C.token(F.col("export_active")),
        "signing_keys": texts("signing"), "export_keys": texts("export"), "anchor_certs": texts("certs"),
    })
    return df.select(F.when(problem.isNull(), text).alias("text"), problem.alias("problem")).withColumn("trust_hash", C.sha(F.col("text")))


def custody(accesses: DataFrame) -> DataFrame:
    """The custody log: accesses (object_id, n, actor, action, at) chained per object by hash.

    Adds entry_hash, prev_hash and chain_hash, so no entry can be taken out or
    changed unseen. Each object's chain is a fold.
    """
    import hashlib

    entry = C.obj({n: C.token(F.col(n)) for n in ("object_id", "actor", "action", "at")})
    df = accesses.withColumn("entry_hash", C.sha(entry))

    def step(state, row):
        before = state or C.GENESIS
        own = "sha256:" + hashlib.sha256((before + row[2]).encode()).hexdigest()
        return own, (before, own)

    return df.join(fold(df, "object_id", ["n"], ["entry_hash"], "prev_hash string, chain_hash string", step), ["object_id", "n"])


def custody_failures(log: DataFrame) -> DataFrame:
    """(object_id, n, rule) of broken entries: ENTRY, CHAIN, LINK. A window per object; custody of one object is short."""
    order = Window.partitionBy("object_id").orderBy("n")
    entry = C.obj({n: C.token(F.col(n)) for n in ("object_id", "actor", "action", "at")})
    before = F.coalesce(F.lag("chain_hash").over(order), F.lit(C.GENESIS))
    df = log.select("*", before.alias("_before"))
    rules = F.array(
        F.when(~F.col("entry_hash").eqNullSafe(C.sha(entry)), "ENTRY"), F.when(~F.col("chain_hash").eqNullSafe(C.sha(F.concat("prev_hash", "entry_hash"))), "CHAIN"), F.when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "LINK"),
    )
    return df.select("object_id", "n", F.explode(F.array_compact(rules)).alias("rule"))
