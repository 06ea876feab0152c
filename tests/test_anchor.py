"""Heads, answers, records and the audit trail's state."""

import json

from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators import anchor, attest

H = "sha256:" + "a" * 64


def test_payloads(spark):
    schema = "db_id string, segment_id string, segment_sequence bigint, segment_hash string, last_row_hash string, head_count bigint, created_at string"
    good = ("d", "seg-000000", 0, H, H, 1, "2026-01-01T00:00:00.000Z")
    bad = [("", *good[1:]), (*good[:2], -1, *good[3:]), (*good[:3], "x", *good[4:]), (*good[:5], 0, good[6]), (*good[:6], "2026-02-30T00:00:00.000Z"), (*good[:6], None)]
    got = [r[0] for r in spark.createDataFrame([good, *bad], schema).select(anchor.payload_problem()).collect()]
    assert got == [None, "db_id", "segment_sequence", "segment_hash", "head_count", "created_at", "created_at"]
    text = spark.createDataFrame([good], schema).select(anchor.payload_text()).first()[0]
    assert C.canonical_text(text) == text


def test_payload_members(spark):
    names = sorted(anchor.PAYLOAD)
    whole = {n: 1 for n in names}
    texts = [whole, {**whole, "x": 1}, {n: 1 for n in names[1:]}, {}, [1], None]
    df = spark.createDataFrame([(json.dumps(t) if t is not None else None,) for t in texts] + [("{",)], "t string")
    assert [r[0] for r in df.select(anchor.payload_members(F.col("t"))).collect()] == [None, "unknown:x", f"missing:{names[0]}", f"missing:{names[0]}", "unreadable", "unreadable", "unreadable"]


def test_forms_of_tokens(spark):
    log = {"log_id": "l", "leaf_index": 0, "inclusion_proof": [], "signed_tree_head": "x"}
    rows = [("rfc3161", "%%"), ("rfc3161", "YQ=="), ("transparency_log", json.dumps(log)), ("transparency_log", json.dumps({**log, "leaf_index": "a"})), ("transparency_log", "YQ=="), ("dual_custodian", "any"), ("dual_custodian", None)]
    df = spark.createDataFrame([(k, "anchored", t, H, H, True) for k, t in rows], "provider_type string, answer string, token string, answered_hash string, payload_hash string, verified boolean")
    assert [r["why"] for r in anchor.outcome(df).collect()] == ["malformed", None, None, "malformed", "malformed", None, "malformed"]


def test_outcomes_and_records(spark):
    rows = [
        ("rfc3161", "anchored", "t", H, H, True, "1"), ("rfc3161", "anchored", "t2", H, H, True, "2"), ("rfc3161", "outage", None, None, H, None, "1"), ("rfc3161", "timeout", None, None, H, None, "1"), ("rfc3161", "anchored", "", H, H, True, "1"),
        ("rfc3161", "anchored", "t", C.GENESIS, H, True, "1"), ("rfc3161", "anchored", "t", H, H, False, "1"), ("nobody", "anchored", "t", H, H, True, "1"), ("rfc3161", None, None, None, H, None, "1"),
    ]
    df = anchor.outcome(spark.createDataFrame(rows, "provider_type string, answer string, token string, answered_hash string, payload_hash string, verified boolean, created_at string"))
    assert [r["status"] for r in df.collect()] == ["anchored", "anchored", "pending", "pending", "failed", "failed", "failed", "failed", "failed"]
    kept = anchor.records(df).collect()
    assert len(kept) == 1 and kept[0]["token"] == "t" and kept[0]["deduplicated"] == 1 and not kept[0]["collision"]


def test_open_window(spark):
    sealed = spark.createDataFrame([(db, "s", 1000 - age) for db, age in (("a", 100), ("b", 150), ("c", 300), ("d", 500), ("e", 999))], "db_id string, segment_id string, sealed_ms bigint")
    got = {r["db_id"]: r["severity"] for r in anchor.open_window(sealed, sealed.where("db_id = 'e'"), 1000, 100).collect()}
    assert got == {"a": "none", "b": "warning", "c": "critical", "d": "emergency"}


def test_audit_plugin(spark):
    v = spark.createDataFrame([("a", "GENERAL_LOG", "on"), ("b", "general_log", "OFF"), ("c", "general_log", "OFF")], "db_id string, name string, value string")
    p = spark.createDataFrame([("b", "server_audit", "active"), ("c", "server_audit", "DISABLED")], "db_id string, plugin_name string, plugin_status string")
    got = {r["db_id"]: (r["logging_active"], r["source"], r["tamper_indicators"]) for r in attest.audit_plugin(v, p).collect()}
    assert got == {"a": (True, "general_log", []), "b": (True, "plugin", []), "c": (False, "unknown", ["AUDIT_PLUGIN_DISABLED"])}
    f = spark.createDataFrame([("HEALTHY", None, False), (None, None, None), ("COMPROMISED", "x", True), ("HEALTHY", None, True)], "fidelity_state string, fidelity_reason string, gap_detected boolean")
    got = [(r["state"], r["reason"]) for r in attest.combined_fidelity(f).select(F.col("state"), F.col("reason")).collect()]
    assert got == [("HEALTHY", None), ("DEGRADED", "no fidelity attestation available"), ("COMPROMISED", "x"), ("DEGRADED", "completeness gap detected")]
