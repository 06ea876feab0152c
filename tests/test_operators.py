"""Operators of the audit engine on small fixtures."""

import base64
import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.functions import ed25519, gtid, merkle
from lodeline.operators import attest, completeness, deadletter, ingest, normalize, rules, segments, validate, verify
from lodeline.plans import audit_queries
from lodeline.sources import objects, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_canonical_text():
    assert C.canonical_text('{"b": [1.0, true, null], "a": "\\u00e9\\u0001\\"", "é": {"z": 1, "y": 2}}') == '{"a":"é\\u0001\\"","b":[1,true,null],"é":{"y":2,"z":1}}'
    assert C.canonical_text('{"\\ue000": 1, "\\ud83d\\ude00": 2}').index("") < C.canonical_text('{"\\ue000": 1, "\\ud83d\\ude00": 2}').index("😀")
    for bad in ("1.5", "NaN", "9007199254740992", '{"e\\u0301": 1, "\\u00e9": 2}', "", "{", "[" * 100_000):
        with pytest.raises(C.NotCanonical):
            C.canonical_text(bad)


def test_columns_equal_python(spark):
    text = 'a"\\\b\f\n\r\t\x01\x1fé😀'
    r = one(spark, s=C.json_string(F.lit(text)), u=C.uuid5(F.lit("x")), h=C.row_hash(F.lit(None).cast("string"), F.lit("sha256:" + "a" * 64)), o=C.obj({"b": F.lit("1"), "a": F.lit(None).cast("string"), "c": F.lit(None).cast("string")}, {"c"}))
    assert r["s"] == json.dumps(text, ensure_ascii=False)
    import uuid

    assert r["u"] == str(uuid.uuid5(uuid.UUID(C.ENVELOPE_NAMESPACE), "x"))
    assert r["h"] == "sha256:" + hashlib.sha256((C.GENESIS + "sha256:" + "a" * 64).encode()).hexdigest()
    assert r["o"] == '{"a":null,"b":1}'
    pairs = [("1", "1.0", 0), ("-2", "1", -1), ("10.05", "10.5", -1), ("-10.05", "-10.5", 1), ("1", "-0", None), ("x", "1", None), ("12345678901234567890", "12345678901234567891", -1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert df.where(~C.decimal_compare(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    assert [r["b"] for r in spark.range(7).select(C.backoff_ms(F.col("id")).alias("b")).collect()] == [1000, 2000, 4000, 8000, 16000, 30000, 30000]


def test_stable_text():
    assert C.stable_text('{"b": 1.50, "a": [{"d": 1, "c": null}]}') == '{"a":[{"c":null,"d":1}],"b":1.5}'
    assert C.stable_text("plain") == "plain" and C.stable_text('"text"') == "text"


def test_gtid(spark):
    a = "3E11FA47-71CA-11E1-9E33-C80AA9429562"
    df = spark.createDataFrame([("mysql", f"{a}:1-5:7"), ("mysql", f" {a}:8-9 , {a[::-1].lower()}:1"), ("mysql", "nonsense"), ("mariadb", "0-1-5"), ("mariadb", "0-1-x"), ("mysql", None)], "engine string, g string")
    got = [[tuple(i) for i in r[0]] for r in df.select(gtid.intervals(F.col("g"), F.col("engine"))).collect()]
    assert got == [[(a.lower(), 1, 5), (a.lower(), 7, 7)], [(a.lower(), 8, 9), (a[::-1].lower(), 1, 1)], [], [("0", 5, 5)], [], []]
    assert [r[0] for r in df.select(gtid.is_valid(F.col("g"), F.col("engine"))).collect()] == [True, False, False, True, False, False]
    rng = random.Random(1)
    spans = [(rng.choice("ab"), s, s + rng.randint(0, 30)) for s in (rng.randint(1, 600) for _ in range(40))]
    held = gtid.merged(spark.createDataFrame(spans, "key string, start bigint, end bigint"), ["key"], width=50)
    sets = {k: {n for kk, s, e in spans if kk == k for n in range(s, e + 1)} for k in "ab"}
    assert {k: sum(r["end"] - r["start"] + 1 for r in held.collect() if r["key"] == k) for k in "ab"} == {k: len(v) for k, v in sets.items()}
    source = spark.createDataFrame([("a", 1, 1000), ("b", 1, 1000), ("c", 1, 5)], "key string, start bigint, end bigint")
    lost = [(r["key"], n) for r in gtid.missing(source, held, ["key"]).collect() for n in range(r["start"], r["end"] + 1)]
    assert sorted(lost) == sorted((k, n) for k, v in sets.items() for n in range(1, max(v)) if n not in v)
    assert one(spark, x=F.lit(1)) and gtid.set_text(gtid.merged(spark.createDataFrame([("s", "k", 1, 2), ("s", "k", 4, 5), ("s", "a", 9, 9)], "s string, key string, start bigint, end bigint"), ["s", "key"]), ["s"]).first()["consumed"] == "a:9,k:1-2:4-5"


def test_merkle(spark):
    def root(leaves):
        if len(leaves) == 1:
            return leaves[0]
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return hashlib.sha256(b"\x01" + root(leaves[:k]) + root(leaves[k:])).digest()

    def path(m, leaves):
        if len(leaves) == 1:
            return []
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return [*path(m, leaves[:k]), root(leaves[k:])] if m < k else [*path(m - k, leaves[k:]), root(leaves[:k])]

    for n in (1, 2, 3, 6, 11):
        leaves = [hashlib.sha256(b"\x00" + hashlib.sha256(bytes([i])).digest()).digest() for i in range(n)]
        df = spark.createDataFrame([("t", i, "sha256:" + hashlib.sha256(bytes([i])).hexdigest()) for i in range(n)], "k string, index bigint, h string")
        got = merkle.roots(df.select("k", "index", merkle.leaf(F.col("h")).alias("hash")), ["k"]).first()
        assert got["root"] == root(leaves).hex() and got["n"] == n
        proofs = spark.createDataFrame([(i, n, leaves[i].hex(), [p.hex() for p in path(i, leaves)]) for i in range(n)], "i bigint, n bigint, leaf string, proof array<string>")
        assert {r[0] for r in proofs.select(merkle.included(F.col("leaf"), F.col("i"), F.col("n"), F.col("proof"))).collect()} == {root(leaves).hex()}


def test_signatures(spark):
    # fixed values: a published test vector
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert ed25519.public_key(seed) == key
    assert ed25519.sign(seed, b"\x72").hex().startswith("92a009a9f0d4cab8720e820b5f642540")
    b64 = lambda x: base64.b64encode(x).decode()
    good = b64(ed25519.sign(seed, b"head"))
    keys = spark.createDataFrame([("k", b64(bytes.fromhex("302a300506032b6570032100") + key), 10, 100)], "key_id string, public_key string, created_ms bigint, revoked_ms bigint")
    uses = [("k", "ed25519", "head", good, 50), ("k", "ed25519", "other", good, 50), ("k", "ed25519", "head", good, 100), ("k", "ed25519", "head", good, 5), ("z", "ed25519", "head", good, 50), ("k", "rsa", "head", good, 50), ("k", "ed25519", "head", "!", 50)]
    bad = verify.signature_failures(spark.createDataFrame(uses, "key_id string, algorithm string, message string, signature string, at_ms bigint"), keys)
    assert sorted(r["problem"] for r in bad.collect()) == ["algorithm", "not_yet_valid", "revoked", "signature", "signature", "unknown"]


def valid_event():
    server = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
    core = {
        "schema_version": "cce-1.0", "kind": "transaction", "source": {"db_id": "d", "engine": "mysql", "server_uuid": server, "schema": "s"}, "transaction": {"tx_id": f"{server}:1", "commit_ts": "2026-06-01T10:22:31.000Z", "ingest_ts": "2026-06-01T10:22:31.000Z", "statement_count": 1},
        "offset": {"gtid": f"{server}:1", "binlog_file": "b.1", "binlog_pos": 4, "lsn": None, "scn": None, "resume_token": None}, "fidelity": {"state": "HEALTHY", "source_config": {}}, "completeness": {"consumed_offset_key": "k", "gap_detected": False, "snapshot_phase": "streaming"},
        "actor": {"attribution_confidence": "exact", "audit_event_ref": "r"},
        "changes": [{"seq": 0, "operation": "UPDATE", "object": {"schema": "s", "name": "t", "primary_key": {"id": 1}}, "before": {"id": 1, "a": "1"}, "after": {"id": 1, "a": "2"}, "field_changes": [{"path": ["a"], "old": "1", "new": "2", "data_type": "string", "changed": True, "sensitive": False}]}],
    }
    return core


def sealed(core):
    import uuid

    core = json.loads(json.dumps(core))
    if "envelope_id" not in core:
        core["envelope_id"] = str(uuid.uuid5(uuid.UUID(C.ENVELOPE_NAMESPACE), f"{core['source']['db_id']}|{core['transaction']['tx_id']}|{core['source']['server_uuid']}"))
    event = "sha256:" + hashlib.sha256(C.canonical_text(json.dumps(core)).encode()).hexdigest()
    row = "sha256:" + hashlib.sha256((C.GENESIS + event).encode()).hexdigest()
    return {**core, "evidence": {"event_hash": event, "prev_row_hash": C.GENESIS, "row_hash": row}}


def test_validation(spark):
    cases = []

    def case(rule, change):
        core = valid_event()
        change(core)
        cases.append((json.dumps(sealed(core)), rule))

    case([], lambda c: None)
    case(["V1"], lambda c: c.update(schema_version="cce-1.7"))
    case(["VERSION_MAJOR", "V1"], lambda c: c.update(schema_version="cce-2.0"))
    case(["V2"], lambda c: c.update(kind="other"))
    case(["V3"], lambda c: c.update(envelope_id="00000000-0000-0000-0000-000000000000"))
    case(["V4"], lambda c: c["transaction"].update(statement_count=99))
    case(["V4"], lambda c: c["changes"][0].update(seq=1))
    case(["V5"], lambda c: c["changes"][0].update(operation="INSERT"))
    case(["V6"], lambda c: c["changes"][0]["object"].pop("primary_key"))
    case(["V6"], lambda c: c["changes"][0]["object"].update(primary_key={}))
    case(["V7"], lambda c: c["changes"][0]["field_changes"][0].pop("changed"))
    case(["V8"], lambda c: c["fidelity"].update(state="GREEN"))
    case(["V8"], lambda c: c["fidelity"].update(state="DEGRADED"))
    case(["V9"], lambda c: c["completeness"].pop("gap_detected"))
    case(["V10"], lambda c: c["actor"].pop("audit_event_ref"))
    case(["V11", "V16"], lambda c: c["offset"].update(gtid=None, binlog_file=None))
    case(["V11", "V16"], lambda c: c["offset"].update(gtid=""))
    case(["V16"], lambda c: c["offset"].update(gtid=None))
    case(["V17"], lambda c: c["completeness"].update(snapshot_phase="snapshot"))
    case(["V18"], lambda c: c["completeness"].update(snapshot_coverage={"status": "incomplete", "expected_rows": 5}))
    e = sealed(valid_event())
    e["evidence"]["event_hash"] = C.GENESIS
    cases.append((json.dumps(e), ["V12"]))
    e = sealed(valid_event())
    e["evidence"]["anchor_ref"] = {"hsm_signature": "s"}
    cases.append((json.dumps(e), ["V13"]))
    cases += [("no json", ["SCHEMA"]), (None, ["SCHEMA"]), ("[1]", ["SCHEMA"])]
    df = validate.validated(spark.createDataFrame(cases, "event string, want array<string>"))
    assert [(r["want"], r["rules"]) for r in df.collect() if r["want"] != r["rules"]] == []


def test_ingest_edges(spark):
    entry = spark.createDataFrame([(["value", "v", "key", "k"],), (["k1", "v1"],), ([],), (["only"],), (["value", "a", "value", "b"],)], "f array<string>")
    assert [tuple(r[0]) for r in entry.select(ingest.decode_entry(F.col("f"))).collect()] == [("k", "v"), ("k1", "v1"), (None, None), (None, None), (None, "b")]
    src = {"connector": "mysql", "db": "s", "table": "t", "gtid": "3e11fa47-71ca-11e1-9e33-c80aa9429562:1", "file": "f", "pos": "12", "ts_ms": 5}
    values = [
        {"op": "c", "after": {"id": 1}, "source": src}, {"schema": {}, "payload": {"op": "u", "before": {"id": 1}, "after": {"id": 2}, "source": {**src, "snapshot": "last"}}}, {"ts_ms": 1}, {"op": "t", "source": src}, {"ddl": "ALTER", "source": {}}, {"op": "x", "source": src},
        {"op": "d", "before": {"x": 1}, "source": {**src, "connector": "mariadb", "gtid": "0-1-2", "server_id": 7, "snapshot": True}}, {"op": "c", "source": {"db": "s"}},
    ]
    raw = spark.createDataFrame([(i, "t", "1-0", json.dumps(v), None) for i, v in enumerate(values)] + [(90, "x-HEARTBEAT", None, None, None), (91, "t", None, "nope", None), (92, None, None, None, None)], "delivery_id bigint, topic string, stream_id string, value_json string, received_at timestamp")
    got = {r["delivery_id"]: r for r in ingest.captured(raw).collect()}
    assert [got[i]["class"] for i in (0, 1, 2, 3, 4, 5, 90, 91)] == ["change", "change", "heartbeat", "other", "other", "other", "heartbeat", "other"]
    assert got[0]["binlog_pos"] == 12 and got[0]["server_uuid"] == "3e11fa47-71ca-11e1-9e33-c80aa9429562" and got[0]["commit_ts"] == "1970-01-01T00:00:00.005Z"
    assert got[1]["snapshot_phase"] == "handoff" and got[6]["snapshot_phase"] == "snapshot" and got[6]["server_uuid"] == "7"
    assert [got[i]["operation"] for i in (0, 1, 3, 4, 5, 6)] == ["INSERT", "UPDATE", "TRUNCATE", "DDL", None, "DELETE"]
    assert got[5]["reason"] == "unsupported or missing CDC op" and got[91]["reason"] == "not JSON" and got[7]["reason"] == "malformed CDC event: missing source.table" and got[92]["reason"] == "no value"
    mt = spark.createDataFrame([("t", "id", None)], "object_name string, pk_columns string, sensitive_columns string")
    keys = {r["delivery_id"]: r["pk"] for r in ingest.with_primary_key(ingest.captured(raw), mt).collect()}
    assert keys[0] == '{"id":1}' and keys[1] == '{"id":1}' and keys[6] is None and keys[3] is None


def test_islands_and_parts(spark):
    keys = ["A", "A", "B", "A", None, None, "C", "C", "C"]
    df = spark.createDataFrame([("d", i * 40_000, k) for i, k in enumerate(keys)], "db_id string, change_id bigint, tx_id string")
    assert [r["island"] // 40_000 for r in normalize.islands(df).orderBy("change_id").collect()] == [0, 0, 2, 3, 4, 5, 6, 6, 6]


def test_changes_without_canonical_form_are_dead_letters(spark):
    columns = "change_id bigint, db_id string, engine string, schema_name string, object_name string, primary_key string, operation string, before_image string, after_image string, ddl_statement string, ddl_effect string, gtid string, binlog_file string, binlog_pos bigint, snapshot_phase string, commit_ts timestamp, ingest_ts timestamp"
    at = datetime.datetime(2026, 6, 1)
    row = lambda n, gtid, after: (n, "d", "mysql", "s", "t", '{"id":1}', "INSERT", None, after, None, None, gtid, "b.1", n, "streaming", at, at)
    good, bad = '{"id":1,"balance":"68.71"}', '{"id":1,"balance":68.71}'
    rows = [row(1, "u:1", good), row(2, "u:2", good), row(3, "u:2", bad), row(4, "u:3", "[1]"), row(9, "u:5", '{"id":1e400}'), row(5, "u:4", good), row(6, "u:4", good), row(7, "u:4", good), row(8, "u:4", bad)]
    items = normalize.prepared(spark.createDataFrame(rows, columns), spark.createDataFrame([("d", "srv")], "db_id string, server_uuid string"))
    grouped = normalize.transactions(items, max_changes=2)
    assert [r["gtid"] for r in normalize.events(grouped).collect()] == ["u:1"]
    got = {r["island"]: (r["statement_count"], r["failure_reason"], r["change_ids"]) for r in normalize.dead_letters(grouped).collect()}
    assert got == {2: (2, "serialization failed: not an integer", [3]), 4: (1, "serialization failed: not an object", [4]), 5: (4, "serialization failed: not an integer", [8]), 9: (1, "serialization failed: not an integer", [9])}


def test_diff_and_mask_of_all_row_changes(spark, tmp_path):
    columns = "change_id bigint, db_id string, schema_name string, object_name string, operation string, before_image string, after_image string"
    rows = [
        (1, "d", "s", "t", "UPDATE", '{"name":"a","n":68.710,"m":1e2}', '{"name":"b","n":68.71,"m":100}'),
        (2, "d", "s", "t", "INSERT", None, '{"n":68.71,"name":"c"}'),
        (3, "d", "s", "t", "UPDATE", '{"n":9007199254740993,"x":{"y":[0.50,1e400]}}', '{"n":9007199254740992,"x":{"y":[0.5,1E+400]}}'),
        (4, "d", "s", "t", "DELETE", '{"n":', None),
        (5, "d", "s", "t", "UPDATE", '{"n":"1"}', '{"n":"1"}'),
    ]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/normalized_change.parquet")
    spark.createDataFrame([("t", "name, x")], "object_name string, sensitive_columns string").write.parquet(f"{tmp_path}/monitored_table.parquet")
    got = sorted((tuple(r) for r in audit_queries.field_diff(spark, str(tmp_path)).collect()), key=str)
    assert got == [
        (1, "name", "string", "a", "b"), (2, "n", "decimal", None, "68.71"), (2, "name", "string", None, "c"),
        (3, "n", "int", "9007199254740993", "9007199254740992"), (4, None, None, None, None),
    ]
    got = sorted((tuple(r) for r in audit_queries.masking(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "name", '"***"', '"***"', True), (2, "name", "null", '"***"', True), (4, None, None, None, None)]


def test_liveness_and_handoff(spark):
    a = spark.createDataFrame([("live", 990, True), ("idle", 990, False), ("idle2", 100, True), ("idle2", 990, False), ("stalled", 1, True), ("none", None, True)], "db_id string, at_ms bigint, is_event boolean")
    got = {r["db_id"]: r["liveness"] for r in completeness.liveness(a, 1000, stall_ms=600, idle_ms=200).collect()}
    assert got == {"live": "live", "idle": "idle", "idle2": "idle", "stalled": "stalled", "none": "idle"}
    s = spark.createDataFrame([("d", i * 70_000, p) for i, p in enumerate(["snapshot", "snapshot", "handoff", "streaming", "snapshot", "streaming"])], "db_id string, change_id bigint, snapshot_phase string")
    assert [(r["change_id"] // 70_000, r["type"]) for r in completeness.handoff_events(s).orderBy("change_id", "type").collect()] == [(0, "snapshot_start"), (2, "snapshot_complete"), (3, "streaming_resumed"), (5, "snapshot_complete"), (5, "streaming_resumed")]


def test_stalls_and_new_alarms(spark):
    live = spark.createDataFrame([("a", 900, "stalled"), ("b", 100, "stalled"), ("c", 990, "live")], "db_id string, last_activity_ms bigint, liveness string")
    assert sorted((r["db_id"], r["severity"]) for r in completeness.stall_alarms(live, 1000, stall_ms=50).collect()) == [("a", "high"), ("b", "critical")]
    raised = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "db_id string, signature string")
    assert completeness.new_alarms(raised, None).count() == 2 and [r["db_id"] for r in completeness.new_alarms(raised, raised.where("db_id = 'a'")).collect()] == ["b"]


def test_attestation_never_healthy_without_proof(spark):
    right = {"log_bin": "on", "binlog_format": "row", "binlog_row_image": "full", "gtid_mode": "on", "binlog_expire_logs_seconds": "86400", "server_uuid": "u"}
    data = [("ok", "mysql", k.upper(), v) for k, v in right.items()]
    for gone in ("log_bin", "binlog_format", "binlog_row_image", "gtid_mode", "binlog_expire_logs_seconds"):
        data += [(f"no {gone}", "mysql", k, v) for k, v in right.items() if k != gone]
    configs = attest.config_rows(spark.createDataFrame(data, "db_id string, engine string, name string, value string"))
    states = {r["db_id"]: r["state"] for r in attest.assessed(configs).collect()}
    assert states.pop("ok") == "HEALTHY" and set(states.values()) == {"DEGRADED"} and len(states) == 5
    unread = attest.sampled(spark.createDataFrame([("x", "mysql")], "db_id string, engine string"), configs, F.lit("2026-01-01T00:00:00.000Z")).first()
    assert unread["state"] == "DEGRADED" and unread["config_snapshot_id"].startswith("cfg-")


def test_segments_by_age_and_tampering(spark):
    data = [("a", i, t) for i, t in enumerate([0, 10, 99, 100, 150, 199, 200, 201, 202, 203])] + [("b", 1, 5)]
    base = spark.createDataFrame(data, "db_id string, arrival bigint, at_ms bigint")
    got = segments.assigned(base, 3, 100).orderBy("db_id", "arrival").collect()
    assert [r["segment_sequence"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 0]
    core = F.concat(F.lit('{"n":'), F.col("arrival").cast("string"), F.lit("}"))
    null = F.lit(None).cast("string")
    ev = segments.assigned(base, 3, 100).select(
        "db_id", "arrival", "segment_sequence", C.uuid5(F.concat("db_id", F.col("arrival").cast("string"))).alias("envelope_id"), core.alias("core"), C.sha(core).alias("event_hash"), F.lpad(F.col("at_ms").cast("string"), 6, "0").alias("commit_iso"), null.alias("gtid"), null.alias("binlog_file"),
        F.lit(None).cast("bigint").alias("binlog_pos"), null.alias("epoch_id"), null.alias("schema_name"), null.alias("object_name"), null.alias("key_hash"), F.lit("HEALTHY").alias("state"), null.alias("reason"), F.lit(False).alias("gap_detected"), F.col("arrival").cast("string").alias("offset_key"))
    o = segments.chained(segments.sequenced(ev)).cache()
    heads = segments.heads(segments.manifests(o)).cache()
    assert verify.object_failures(o).count() == verify.list_failures(o, heads).count() == verify.cross_failures(heads).count() == verify.segment_gaps(heads).count() == verify.event_gaps(heads).count() == 0
    assert {r["rule"] for r in verify.object_failures(o.withColumn("core", F.when(F.col("arrival") == 4, "{}").otherwise(F.col("core")))).collect()} == {"EVENT_HASH"}
    assert {r["rule"] for r in verify.list_failures(o.where("arrival <> 4"), heads).collect()} == {"MISSING"}
    assert {r["rule"] for r in verify.cross_failures(heads.where("segment_sequence <> 1")).collect()} == {"MISSING_PREVIOUS"}
    assert [(r["segment_sequence"], r["problem"]) for r in verify.segment_gaps(heads.where("segment_sequence <> 1")).collect()] == [(1, "missing")]
    dbs = heads.select("db_id").distinct()
    checks = dict.fromkeys(verify.REQUIRED, verify.segment_gaps(heads))
    assert {r["overall"] for r in verify.report(dbs, checks).collect()} == {"PASS"}
    assert {r["overall"] for r in verify.report(dbs, {**checks, "anchor_token": None}).collect()} == {"FAIL"}
    assert sinks.exit_code(verify.report(dbs, checks)) == 0
    lost, gaps = verify.exportable(o.select("db_id", "envelope_id"), heads.where("segment_sequence < 2"))
    assert lost.count() == 4 and gaps.count() == 0


def test_dead_letters(spark):
    f = spark.createDataFrame([("mysql", "o", "Unexpected token x", '{"b":1,"a":2}', 1), ("mysql", "o", "Unexpected token x", '{"a":2,"b":1}', 2), ("mysql", None, None, None, 3), ("mysql", None, "boom", "x", 4)], "source_engine string, offset_key string, failure_reason string, payload string, seen bigint")
    r = deadletter.records(f).withColumn("delivery_id", F.col("seen")).cache()
    assert [x["failure_category"] for x in r.orderBy("seen").collect()] == ["MALFORMED_CDC_EVENT", "MALFORMED_CDC_EVENT", "UNCLASSIFIED", "UNEXPECTED_EXCEPTION"]
    got = {x["failure_category"]: x for x in deadletter.upserted(r).collect()}
    assert len(got) == 3 and got["MALFORMED_CDC_EVENT"]["retry_count"] == 1 and got["UNEXPECTED_EXCEPTION"]["status"] == "retryable"
    assert deadletter.depth_alarm(deadletter.upserted(r), 2).first()["severity"] == "high" and deadletter.depth_alarm(deadletter.upserted(r), 3).count() == 0


def test_rows_the_sql_cannot_decide(spark, tmp_path):
    payloads = [(1, "stated", '{"b":1,"a":2}'), (2, None, '{"b":1,"a":[{"d":1,"c":2}]}'), (3, None, "no JSON"), (4, None, None)]
    spark.createDataFrame(payloads, "delivery_id bigint, payload_hash string, original_payload string").write.parquet(f"{tmp_path}/dlq.parquet")
    sha = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    got = {r["delivery_id"]: r["payload_hash"] for r in audit_queries.payload_hashes(spark, str(tmp_path)).collect()}
    assert got == {1: sha('{"a":2,"b":1}'), 2: sha('{"a":[{"c":2,"d":1}],"b":1}'), 3: sha("no JSON"), 4: sha("null")}

    times = [datetime.datetime(2026, 6, 1, 9), datetime.datetime(2026, 6, 1, 20), datetime.datetime(2026, 6, 6, 9), None]  # a Monday, twice, and a Saturday
    rows = [(n, "d", "t", "INSERT", None, "{}", at, "b.000001", n, 0) for n, at in enumerate(times)]
    spark.createDataFrame(rows, "change_id bigint, db_id string, object_name string, operation string, before_image string, after_image string, commit_ts timestamp, binlog_file string, binlog_pos bigint, row_no int").write.parquet(f"{tmp_path}/normalized_change.parquet")
    assert {r["change_id"]: r["outside"] for r in audit_queries.rule_outside_hours(spark, str(tmp_path)).collect()} == {0: False, 1: True, 2: True, 3: None}


def test_rules(spark):
    df = spark.createDataFrame([(1, None, '{"a": 10}'), (2, True, '{"a": "12.5"}'), (3, False, "{}")], "n int, known boolean, after_image string")
    rule = {"id": "r", "base": 10, "when": {"any": [{"leaf": "field_value", "field": "a", "op": ">", "value": 11}, {"leaf": "flag", "column": "known"}]}, "modifiers": [{"add": 95, "when": {"leaf": "field_value", "field": "a", "op": "exists", "value": True}}]}
    got = {r["n"]: (r["outcome"], r["score"], r["severity"]) for r in rules.evaluated(df, [rule]).collect()}
    assert got == {1: ("INDETERMINATE", 0, None), 2: ("FIRED", 100, "critical"), 3: ("NOT_FIRED", 0, None)}
    deep = {"leaf": "flag", "column": "known"}
    for _ in range(9):
        deep = {"not": deep}
    for bad in (deep, {"leaf": "nothing"}, {"all": [{"leaf": "flag", "column": "known"}] * 65}):
        with pytest.raises(ValueError):
            rules.compiled({"id": "x", "when": bad})
    alerts = spark.createDataFrame([("k", t) for t in (0, 50, 99, 200, 301, 302)], "k string, at bigint")
    assert sorted((r["first_ms"], r["occurrences"]) for r in rules.suppressed(alerts, "k", "at", 100).collect()) == [(0, 3), (200, 1), (301, 2)]
    assert [r["emitted"] for r in rules.cooled(alerts, "k", "at", 100).orderBy("at").collect()] == [True, False, False, True, True, False]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    sinks.put_new(rows, str(tmp_path / "o"))
    with pytest.raises(sinks.AlreadyThere):
        sinks.put_new(rows.where("key = 'a'"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    got = sinks.latest_by_key(rows, spark.createDataFrame([("a", 5), ("c", 1)], "key string, v int"), ["key"], "v")
    assert sorted(map(tuple, got.collect())) == [("a", 5), ("b", 2), ("c", 1)]
    found, lost = objects.hydrated(spark.createDataFrame([("a",), ("../a",), ("z",)], "key string"), rows)
    assert [r["key"] for r in found.collect()] == ["a"] and sorted(r["key"] for r in lost.collect()) == ["../a", "z"]
    with pytest.raises(ValueError):
        objects.package('{"db_id": "d"}')
    whole = {"package_version": "v", "package_id": "p", "db_id": "d", "purpose": "x", "created_at": "t", "created_by": "me", "object_refs": [{"object_id": "o", "object_type": "cce", "worm_object_key": "k", "event_hash": "h"}], "segment_manifests": ["{}"], "anchor_records": [], "public_keys": []}
    assert objects.package(json.dumps(whole)) == whole
    for bad in ({"extra": 1}, {"segment_manifests": ["x"]}, {"segment_manifests": [{}]}, {"object_refs": [{"object_id": "o"}]}, {"created_by": None}, {"export_signature": "s"}):
        with pytest.raises(ValueError):
            objects.package(json.dumps({**whole, **bad}))
    assert objects.generated_changes(spark, 50).count() == 50
    drill = objects.drill(spark, 10).collect()
    assert len({r["label"] for r in drill}) == 9 and sum(r["label"] == "load" for r in drill) == 10 and len({r["change_id"] for r in drill}) == len(drill)
    d = spark.createDataFrame([(True, 5, "delete"), (False, 15, "delete"), (False, 5, "delete"), (False, 5, "extend")], "held boolean, until int, act string")
    assert [r[0] for r in d.select(sinks.retention_decision(F.col("held"), F.col("until"), F.lit(10), F.col("act"), F.lit(4))).collect()] == ["DENY_HOLD", "DENY_RETENTION", "ALLOW", "DENY_BACKWARD"]


def test_leaves(spark):
    row = [(["UPDATE", "DELETE", "UPDATE"], ["a", "b", "a"], "ann", "admin", "probable", True, False, "DEGRADED", None, "MINIMAL", ["AUDIT_PLUGIN_DISABLED"], True), (["DELETE"], ["a"], None, None, None, False, True, "HEALTHY", True, None, [], False)]
    df = spark.createDataFrame(row, "operations array<string>, tables array<string>, actor string, actor_role string, attribution_confidence string, new_actor boolean, unusual_host boolean, fidelity_state string, gap_detected boolean, binlog_row_image string, tamper_indicators array<string>, sensitive boolean")

    def fired(**leaf):
        return [r["outcome"] == "FIRED" if r["outcome"] != "INDETERMINATE" else None for r in rules.evaluated(df, [{"id": "r", "when": leaf}]).collect()]

    t = lambda p, **x: fired(leaf="transaction", predicate=p, **x)
    assert t("statement_count", op=">", value=2) == [True, False] and t("distinct_tables_count", op="==", value=2) == [True, False] and t("contains_operation", value="UPDATE") == [True, False]
    assert t("all_operations_are", value="DELETE") == [False, True] and t("touches_table", value="b") == [True, False]
    u = lambda p, **x: fired(leaf="user_behavior", predicate=p, **x)
    assert u("actor_in_list", values=["ann"]) == [True, False] and u("actor_not_in_list", values=["bob"]) == [True, False] and u("privilege_role_in", values=["admin"]) == [True, False]
    assert u("confidence_below", value="exact") == [True, True] and u("confidence_below", value="probable") == [False, True] and u("new_actor") == [True, False] and u("unusual_host") == [False, True]
    f = lambda p: fired(leaf="fidelity", predicate=p)
    assert f("state_not_healthy") == [True, False] and f("gap_detected") == [None, True] and f("row_image_downgraded") == [True, None] and f("audit_plugin_disabled") == [True, False] and f("attribution_unavailable_on_sensitive") == [False, False]
    for leaf in ("transaction", "user_behavior", "fidelity"):
        with pytest.raises(ValueError):
            fired(leaf=leaf, predicate="nothing")
    a = spark.createDataFrame([("x", "h1", 0), ("x", "h2", 50), ("x", "h1", 300), (None, "h1", 0), ("y", None, 5), ("y", "h1", 5)], "actor string, client_host string, at_ms bigint")
    got = {(r["actor"], r["client_host"], r["at_ms"]): (r["new_actor"], r["unusual_host"]) for r in rules.known_actors(a, spark.createDataFrame([("x", "h1")], "actor string, client_host string"), 100).collect()}
    assert got == {("x", "h1", 0): (True, False), ("x", "h2", 50): (False, True), ("x", "h1", 300): (True, False), (None, "h1", 0): (False, False), ("y", None, 5): (True, False), ("y", "h1", 5): (True, True)}
    other = spark.createDataFrame([(1, 5), (1, 9), (2, None)], "k int, w int")
    mine = spark.createDataFrame([(1, 7), (1, 9), (2, 1), (3, 1)], "k int, v int")
    flags = lambda op: [r["ok"] for r in rules.field_compared(mine, other, ["k"], "ok", "v", op, "w").orderBy("k", "v").collect()]
    assert flags(">") == [True, True, False, False] and flags("<") == [True, False, False, False] and flags("==") == [False, True, False, False] and flags("!=") == [True, True, False, False]
    kinds = spark.createDataFrame([('{"kind":"transaction"}',), ('{"kind":"snapshot_epoch_manifest"}',), ('{"kind":1}',), ("x",), (None,)], "c string")
    assert [r[0] for r in kinds.select(validate.object_kind(F.col("c"))).collect()] == ["cce", "epoch_manifest", None, None, None]
