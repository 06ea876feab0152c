"""Proof tokens, anchors, exports, the key registry, custody, epochs, attribution."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.functions import ed25519, proofs
from lodeline.operators import export, normalize, projection, registry, segments, verify
from lodeline.plans import audit_queries, bridge

SEED, OTHER = b"\x07" * 32, b"\x08" * 32
KEY = base64.b64encode(ed25519.public_key(SEED)).decode()
HASHES = ["sha256:" + f"{i:064x}" for i in range(1, 14)]
AT = "2026-01-01T00:00:00Z"


def why(check, *args):
    try:
        check(*args)
    except proofs.Refused as reason:
        return str(reason)
    return None


def changed(token, **members):
    doc = json.loads(base64.b64decode(token))
    for path, value in members.items():
        at = doc
        *way, last = path.split("__")
        for name in way:
            at = at[name]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return base64.b64encode(json.dumps(doc).encode()).decode()


def test_time_stamps():
    t = proofs.stamp(SEED, HASHES[0], "ref", AT, "1")
    assert why(proofs.check_stamp, t, HASHES[0], "ref", KEY) is None
    cases = {
        "imprint_mismatch": (t, HASHES[1], "ref", KEY), "cert_mismatch": (t, HASHES[0], "x", KEY), "malformed_token": ("%%", HASHES[0], "ref", KEY),
        "signature_invalid": (proofs.stamp(OTHER, HASHES[0], "ref", AT, "1"), HASHES[0], "ref", KEY), "algorithm_mismatch": (changed(t, signature_algorithm="rsa"), HASHES[0], "ref", KEY),
        "malformed_tstinfo": (changed(t, tst_info__gen_time="2026-02-30T00:00:00Z"), HASHES[0], "ref", KEY),
    }
    assert {k: why(proofs.check_stamp, *v) for k, v in cases.items()} == {k: k for k in cases}
    assert why(proofs.check_stamp, changed(t, tst_info__policy=None), HASHES[0], "ref", KEY) == "malformed_tstinfo"
    assert why(proofs.check_stamp, changed(t, tst_info__serial_number="2"), HASHES[0], "ref", KEY) == "signature_invalid"


def test_inclusion_in_logs_of_every_size():
    for n in range(1, 14):
        tokens = proofs.inclusions(SEED, HASHES[:n], "log", AT)
        for i, t in enumerate(tokens):
            assert why(proofs.check_inclusion, t, HASHES[i], "log", KEY) is None
            assert why(proofs.check_inclusion, t, HASHES[(i + 1) % 13], "log", KEY) == ("inclusion_invalid")
            doc = json.loads(t)
            if doc["inclusion_proof"]:
                short = json.dumps({**doc, "inclusion_proof": doc["inclusion_proof"][:-1]})
                assert why(proofs.check_inclusion, short, HASHES[i], "log", KEY) == "inclusion_invalid"
            assert why(proofs.check_inclusion, json.dumps({**doc, "leaf_index": n}), HASHES[i], "log", KEY) == "inclusion_invalid"
            longer = json.dumps({**doc, "inclusion_proof": [*doc["inclusion_proof"], "0" * 64]})
            assert why(proofs.check_inclusion, longer, HASHES[i], "log", KEY) == "inclusion_invalid"
    t = json.loads(proofs.inclusions(SEED, HASHES[:3], "log", AT)[0])
    assert why(proofs.check_inclusion, json.dumps(t), HASHES[0], "other", KEY) == "log_mismatch"
    assert why(proofs.check_inclusion, json.dumps({**t, "inclusion_proof": ["x"]}), HASHES[0], "log", KEY) == "malformed_proof"
    assert why(proofs.check_inclusion, json.dumps({**t, "signed_tree_head": changed(t["signed_tree_head"], sth__tree_size=0)}), HASHES[0], "log", KEY) == "malformed_sth"
    assert why(proofs.check_inclusion, json.dumps({**t, "signed_tree_head": changed(t["signed_tree_head"], sth__sth_time="2026-01-02T00:00:00Z")}), HASHES[0], "log", KEY) == "sth_signature_invalid"
    assert why(proofs.check_inclusion, "no json", HASHES[0], "log", KEY) == "malformed_proof"


def test_tokens_as_a_column(spark):
    t, log = proofs.stamp(SEED, HASHES[0], "ref", AT, "1"), proofs.inclusions(SEED, HASHES[:2], "log", AT)[1]
    rows = [("rfc3161", t, HASHES[0], "ref", KEY, "ed25519"), ("transparency_log", log, HASHES[1], "log", KEY, "ed25519"), ("fax", t, HASHES[0], "ref", KEY, "ed25519"), ("rfc3161", t, HASHES[0], None, None, None), ("rfc3161", t, HASHES[0], "ref", KEY, "rsa"), ("rfc3161", None, HASHES[0], "ref", KEY, "ed25519"), ("rfc3161", t, "x", "ref", KEY, "ed25519")]
    df = spark.createDataFrame(rows, "kind string, token string, hash string, ref string, key string, algorithm string")
    got = [r[0] for r in df.select(proofs.token_problem("kind", "token", "hash", "ref", "key", "algorithm")).collect()]
    assert got == [None, None, "unsupported_provider", "missing_certificate", "algorithm_mismatch", "malformed_token", "invalid_payload_hash"]


def chained(spark, n=40, cap=7):
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("db_id"), F.col("id").alias("arrival"), F.concat(F.lit("e"), "id").alias("envelope_id"), C.sha(F.col("id").cast("string")).alias("event_hash"), F.col("id").cast("string").alias("core"),
        F.lit("2026-01-01T00:00:00.000Z").alias("commit_iso"), F.concat(F.lit("g:"), "id").alias("gtid"), F.lit(None).cast("string").alias("binlog_file"), F.lit(None).cast("bigint").alias("binlog_pos"), F.lit(None).cast("string").alias("epoch_id"),
        F.lit("s").alias("schema_name"), F.lit("t").alias("object_name"), F.lit("k").alias("key_hash"), F.lit("HEALTHY").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("gap_detected"), F.concat(F.lit("g:"), "id").alias("offset_key"))
    return segments.chained(segments.sequenced(segments.assigned_by_count(rows, cap)))


def test_manifests_and_sealing(spark):
    objects = chained(spark)
    m = segments.heads(segments.manifests(objects))
    assert verify.manifest_failures(m).count() == 0 and verify.cross_failures(m).count() == 0
    rules = lambda df: {r["rule"] for r in verify.manifest_failures(df).collect()}
    assert rules(m.withColumn("event_count", F.col("event_count") + 1)) == {"MANIFEST_HASH", "EVENT_COUNT"}
    assert rules(m.withColumn("degraded_count", F.lit(3).cast("bigint"))) == {"MANIFEST_HASH"}
    assert rules(m.withColumn("last_envelope_id", F.lit("x"))) == {"MANIFEST_HASH", "ENDPOINTS"}
    assert "LIST_INDEX" in rules(m.withColumn("objects", F.reverse("objects")))
    ok = segments.sealed(objects)
    assert {r["status"] for r in ok.collect()} == {"SEALED"}
    bad = objects.withColumn("core", F.when(F.col("envelope_id") == "e20", "x").otherwise(F.col("core")))
    got = {(r["db_id"], r["segment_sequence"]): (r["status"], r["problems"]) for r in segments.sealed(bad).collect()}
    assert got["a", 0][0] == "SEALED" and got["a", 1] == ("REFUSED", ["EVENT_HASH"]) and got["a", 2] == ("REFUSED", []) and got["b", 2][0] == "SEALED"


def test_exports(spark):
    objects = chained(spark)
    m = segments.heads(segments.manifests(objects)).where("db_id = 'a' and segment_sequence <= 1")
    selected = objects.where("envelope_id in ('e2', 'e20')").select("db_id", "envelope_id")
    records = audit_queries._records(m)
    described = spark.createDataFrame([("a", "p1", "case", AT, "me"), ("b", "p2", "case", AT, "me")], "db_id string, package_id string, purpose string, created_at string, created_by string")
    keys = audit_queries._keys(spark, "key-1")
    made = export.packages(selected, m, records, keys, described).collect()
    assert [r["package_id"] for r in made] == ["p1"] and C.canonical_text(made[0]["body"]) == made[0]["body"]
    body = json.loads(made[0]["body"])
    assert [r["object_id"] for r in body["object_refs"]] == ["e2", "e20"] and [json.loads(t)["segment_sequence"] for t in body["segment_manifests"]] == [0, 1] and len(body["anchor_records"]) == 2
    problems = lambda *a: {r["problem"] for r in export.selection_problems(*a).collect()}
    assert problems(selected, m.where("segment_sequence = 1"), records) == {"uncovered", "missing"}
    assert problems(selected.where("envelope_id = 'e2'"), m, records) == {"beyond"}
    assert problems(selected, m, records.limit(0)) == {"no_anchor"} and problems(selected.limit(0), m, records) == {"no_objects"} and problems(selected, m.unionByName(m), records) == {"duplicate"}
    assert export.packages(selected, m, records.limit(0), keys, described).count() == 0
    early = keys.withColumn("created_ms", F.lit(1 << 50))
    sealed = spark.createDataFrame(made).withColumn("signing_key_id", F.lit("key-1")).withColumn("algorithm", F.lit("ed25519"))
    sealed = sealed.withColumn("signature", proofs.signer(audit_queries.SEEDS["key-1"])(export.signing_message(F.col("package_hash"))))
    assert export.seal_failures(sealed, keys).count() == 0
    assert [r["problem"] for r in export.seal_failures(sealed, early).collect()] == ["not_yet_valid"]
    assert [r["problem"] for r in export.seal_failures(sealed.withColumn("algorithm", F.lit("rsa")), keys).collect()] == ["algorithm"]
    assert spark.range(1).select(export.package_key(F.lit("a"), F.lit("p"))).first()[0] == "exports/a/p.json"


def test_package_hashes_without_bodies(spark, monkeypatch):
    objects = chained(spark, 60)
    m = segments.heads(segments.manifests(objects))
    selected = objects.where("arrival % 4 >= 2 or arrival > 55").select("db_id", "envelope_id")
    records = audit_queries._records(m)
    rows = [("a", "p1", "case", AT, "me"), ("a", "p3", 'é"\\\n\x01' * 50, AT, None), ("b", "p2", "case", AT, "me"), ("c", "p4", "case", AT, "me")]
    described = spark.createDataFrame(rows, "db_id string, package_id string, purpose string, created_at string, created_by string")
    keys = audit_queries._keys(spark, "key-1", "key-x")
    monkeypatch.setattr(export, "PIECE", 37)
    for anchored, n in (("db_id = 'b'", 1), ("true", 3), ("false", 0)):
        some = records.where(anchored)
        want = {(r["db_id"], r["package_id"]): r["package_hash"] for r in export.packages(selected, m, some, keys, described).collect()}
        got = {(r["db_id"], r["package_id"]): r["package_hash"] for r in export.package_hashes(selected, m, some, keys, described).collect()}
        assert got == want and len(got) == n


def test_seals_build_no_body(spark, monkeypatch):
    """A package of some hundred thousand objects is no row that an executor can hold."""
    monkeypatch.setattr(export, "packages", None)
    got = {(r["package_id"], r["problem"]) for r in audit_queries.export_seals(spark, "/root/testdata/sf0.001").collect()}
    assert got == {("package-db-1", "package_hash"), ("package-db-2", "unknown"), ("package-db-3", "signature")}


def test_json_in_json(spark):
    texts = ['{"a":"b\\\\"}', "", "é\n\x01\x1f\"", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.json_text(F.col("t"))).collect()] == [t if t is None else json.dumps(t, ensure_ascii=False) for t in texts]


def test_registry_and_trust_file(spark):
    step = lambda n, kind, key, created=0, revoked=None, asked="x", approved="y", registry="sign": (registry, n, kind, key, "ed25519", "PUB" + str(key), created, revoked, asked, approved)
    steps = [
        step(1, "register", "k1"), step(2, "rotate", "k1"), step(3, "rotate", "k2", asked="x", approved="x"), step(4, "rotate", "k2", approved=None), step(5, "revoke", "k1", revoked=50), step(6, "rotate", "k2", created=10), step(7, "revoke", "k1", revoked=-5),
        step(8, "revoke", "k1", revoked=50), step(9, "revoke", "k1", revoked=60), step(10, "revoke", "nobody", revoked=1), step(11, "rotate", "k3", revoked=99), step(12, "dance", "k3"), step(1, "register", "e1", registry="export"),
    ]
    df = registry.decided(spark.createDataFrame(steps, "registry string, n int, kind string, key_id string, algorithm string, public_key string, created_ms bigint, revoked_ms bigint, requested_by string, approved_by string"))
    got = {(r["registry"], r["n"]): (r["verdict"], r["active"]) for r in df.collect()}
    assert [got["sign", n][0] for n in range(1, 13)] == ["ACCEPTED", "KEY_EXISTS", "DUAL_CONTROL_SAME_PERSON", "DUAL_CONTROL_MISSING", "KEY_IS_ACTIVE", "ACCEPTED", "REVOKED_BEFORE_CREATED", "ACCEPTED", "ALREADY_REVOKED", "UNKNOWN_KEY", "ACTIVE_KEY_REVOKED", "UNKNOWN_STEP"]
    keys = registry.keys_of(df)
    assert {(r["key_id"], r["revoked_ms"], r["active"]) for r in keys.where("registry = 'sign'").collect()} == {("k1", 50, False), ("k2", None, True)}
    certs = spark.createDataFrame([("tsa", "ed25519", "C")], "ref string, algorithm string, public_key string")
    sign, exp = keys.where("registry = 'sign'"), keys.where("registry = 'export'")
    row = registry.trust_file(sign, exp, certs, 1, AT).first()
    assert row["problem"] is None and C.canonical_text(row["text"]) == row["text"] and [k["key_id"] for k in json.loads(row["text"])["signing_keys"]] == ["k1", "k2"]
    assert json.loads(row["text"])["active_signing_key_id"] == "k2"
    problem = lambda *a: registry.trust_file(*a).first()["problem"]
    assert problem(sign, sign, certs, 1, AT) == "key_in_both_planes" and problem(sign, exp, certs, 0, AT) == "trust_version" and problem(sign, exp, certs, 1, "x") == "generated_at"
    assert problem(sign.withColumn("public_key", F.lit("-----BEGIN CERTIFICATE-----")), exp, certs, 1, AT) == "certificate_among_keys"
    assert problem(sign.limit(0), exp.limit(0), certs.limit(0), 1, AT) == "empty" and problem(sign, exp, certs.withColumn("ref", F.lit("")), 1, AT) == "malformed_certificate"


def test_custody(spark):
    log = registry.custody(spark.createDataFrame([("o", i, "a", "read", AT) for i in range(4)], "object_id string, n int, actor string, action string, at string"))
    assert registry.custody_failures(log).count() == 0
    rules = lambda df: {(r["n"], r["rule"]) for r in registry.custody_failures(df).collect()}
    assert rules(log.withColumn("actor", F.when(F.col("n") == 1, "b").otherwise(F.col("actor")))) == {(1, "ENTRY")}
    assert rules(log.where("n <> 1")) == {(2, "LINK")}


def test_epoch_manifests(spark):
    epochs = spark.createDataFrame([("d", "e1", 1, "u", "f", 4, AT, None, None), ("d", "e2", 2, "u", "f", 9, AT, "g", "e1")], "db_id string, epoch_id string, n int, server_uuid string, binlog_file string, binlog_pos bigint, start_ts string, handoff_gtid string, supersedes string")
    tables = spark.createDataFrame([("d", "e1", "b", 2, 2), ("d", "e1", "a", None, 1)], "db_id string, epoch_id string, object string, expected_rows bigint, emitted_rows bigint")
    one, two = projection.epoch_manifests(epochs, tables).orderBy("n").collect()
    assert C.canonical_text(one["core"]) == one["core"] and [t["object"] for t in json.loads(one["core"])["tables"]] == ["a", "b"] and json.loads(two["core"])["tables"] == []
    assert one["prev_row_hash"] == C.GENESIS and two["prev_row_hash"] == one["row_hash"]


def brute_attribution(events, audits, window):
    out = {}
    for e, db, at, tables, *keys in events:
        near = [a for a in audits if a[1] == db and abs(a[2] - at) <= window]
        about = [a for a in near if not a[3] or set(a[3]) & set(tables)]
        hard = [a for a in about if any(k is not None and k == x for k, x in zip(keys, a[4:7], strict=True))]
        if any(a[7] for a in near):
            out[e] = ("unattributed", None, len(about))
        elif len(hard) == 1:
            out[e] = ("exact", hard[0][0], len(about))
        elif len(about) == 1:
            out[e] = ("probable", about[0][0], 1)
        else:
            out[e] = ("unattributed", None, len(about))
    return out


def test_attribution_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    events = [(f"e{i}", rng.choice("ab"), rng.randint(0, 3000), rng.sample(["t0", "t1", "t2", "t3"], rng.randint(0, 3)), some(4), some(4), some(9)) for i in range(150)]
    audits = [(i, rng.choice("ab"), rng.randint(-50, 3050), rng.choice([None, [], [f"t{rng.randint(0, 3)}"], ["t0", "t3"]]), some(4), some(4), some(9), rng.random() < 0.02) for i in range(120)]
    e = spark.createDataFrame(events, "envelope_id string, db_id string, commit_ms bigint, tables array<string>, connection_id int, thread_id int, gtid int")
    a = spark.createDataFrame(audits, "audit_event_id bigint, db_id string, event_ms bigint, objects array<string>, connection_id int, thread_id int, gtid int, tampered boolean")
    for window in (10, 40, 200):
        got = {r["envelope_id"]: (r["confidence"], r["audit_event_id"], r["candidates"]) for r in normalize.attributed(e, a, window).collect()}
        want = brute_attribution(events, audits, window)
        assert got == want
        assert {c for c, _, _ in want.values()} == {"exact", "probable", "unattributed"}
    assert normalize.attributed(e.limit(0), a).count() == 0
    assert {r["confidence"] for r in normalize.attributed(e, a.limit(0)).collect()} == {"unattributed"}


def test_distinct_offenders(spark):
    df = spark.createDataFrame([("d", 1, "A"), ("d", 1, "B"), ("d", 2, "A")], "db_id string, segment_sequence int, rule string")
    got = verify.offending({"x": df, "y": None}, ["segment_sequence"])
    assert sorted((r["check"], r["id"]) for r in got.collect()) == [("x", "1"), ("x", "2")]


@pytest.mark.parametrize("name", ["cross_segment", "verification_report"])
def test_plants_show(spark, name):
    rows = audit_queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    if name == "cross_segment":
        assert {r["rule"] for r in rows} == {"GENESIS", "MISSING_PREVIOUS", "DB_ID", "SEQUENCE", "PREVIOUS_SEGMENT", "PREVIOUS_SEGMENT_HASH", "ROW_BOUNDARY"}
    else:
        assert {r["check"] for r in rows if r["result"] == "FAIL"} == set(verify.CHECKS) and {r["overall"] for r in rows if r["db_id"] == "db-0"} == {"PASS"}
    assert bridge.SERVER
