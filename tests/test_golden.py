"""Events against a plain implementation of the record: ids and hashes must agree to the byte."""

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators import normalize, validate

SERVER = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
SOURCE_CONFIG = {"binlog_format": "ROW", "binlog_row_image": "FULL", "gtid_mode": "ON", "log_bin": "ON", "config_snapshot_id": "cfg-1"}
UNKNOWN = {"attribution_confidence": "unattributed"}
KNOWN = {"db_user": "ops", "client_host": "10.0.7.21", "connection_id": "338217", "attribution_confidence": "exact", "audit_event_ref": "audit-44711", "correlation_basis": ["connection_id", "gtid", "time_window"]}

CASES = [
    {"object": "gifts", "operation": "UPDATE", "pk": {"id": 7}, "before": {"id": 7, "amount": "100.00", "status": "ok", "note": None}, "after": {"id": 7, "amount": "100000.00", "status": "ok", "note": 'é"\n'}, "gtid": f"{SERVER}:152", "phase": "streaming", "names": [], "actor": KNOWN},
    {"object": "people", "operation": "DELETE", "pk": {"id": 8}, "before": {"id": 8, "name": "A", "national_id": "2011", "tags": [1, {"z": True, "a": None}]}, "after": None, "gtid": f"{SERVER}:154", "phase": "streaming", "names": ["aid.people.name", "national_id"], "actor": UNKNOWN},
    {"object": "gifts", "operation": "INSERT", "pk": {"id": 7}, "before": None, "after": {"id": 7, "amount": "-0.50", "email": "d@example.org", "open": False}, "gtid": None, "phase": "snapshot", "names": ["gifts.email"], "actor": UNKNOWN},
]
COMMIT, INGEST = "2026-06-01T09:30:00.000Z", "2026-06-01T09:30:05.000Z"

SCHEMA = (
    "change_id bigint, db_id string, engine string, server_uuid string, schema_name string, object_name string, pk string, operation string, before_image string, after_image string,"
    " ddl_statement string, ddl_effect string, gtid string, binlog_file string, binlog_pos bigint, snapshot_phase string, commit_iso string, ingest_iso string, engine_version string"
)


def write(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def label(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (list, dict)):
        return "json"
    return "int" if isinstance(value, int) else "decimal" if value.replace(".", "", 1).lstrip("-").isdigit() and "." in value else "string"


def plain(c):
    """The record by the book, in dictionaries."""
    secret = lambda name: any(n in (name, f"{c['object']}.{name}", f"aid.{c['object']}.{name}") for n in c["names"])
    veil = lambda name, x: "***" if secret(name) and x is not None else x
    image = lambda i: None if i is None else {k: veil(k, v) for k, v in i.items()}
    b, a = c["before"] or {}, c["after"] or {}
    fields = []
    for name in sorted({*b, *a}):
        old, new = b.get(name), a.get(name)
        if c["operation"] != "UPDATE" or old != new:
            f = {"path": [name], "old": veil(name, old), "new": veil(name, new), "data_type": label(old if new is None else new), "changed": True, "sensitive": secret(name)}
            fields.append({**f, "masked": True} if secret(name) else f)
    epoch = None
    tx = key = c["gtid"]
    if tx is None:
        epoch = "snap-" + sha(write({"db_id": "aid-1", "server_uuid": SERVER, "snapshot_start_binlog_file": "bin.000042", "snapshot_start_binlog_pos": 1152, "snapshot_start_ts": COMMIT}))[:16]
        tx = f"snapshot:{epoch}:" + sha(write({"schema": "aid", "name": c["object"], "primary_key": c["pk"]}))
        key = f"snapshot-epoch:{epoch}"
    completeness = {"consumed_offset_key": key, "gap_detected": False, "snapshot_phase": c["phase"], **({"snapshot_epoch_id": epoch} if epoch else {})}
    return {
        "schema_version": "cce-1.1" if epoch else "cce-1.0", "envelope_id": str(uuid.uuid5(uuid.UUID(C.ENVELOPE_NAMESPACE), f"aid-1|{tx}|{SERVER}")), "kind": "transaction",
        "source": {"db_id": "aid-1", "engine": "mysql", "server_uuid": SERVER, "schema": "aid"}, "transaction": {"tx_id": tx, "commit_ts": COMMIT, "ingest_ts": INGEST, "statement_count": 1},
        "offset": {"gtid": c["gtid"], "binlog_file": "bin.000042", "binlog_pos": 1152, "lsn": None, "scn": None, "resume_token": None},
        "fidelity": {"state": "HEALTHY", "source_config": SOURCE_CONFIG}, "completeness": completeness, "actor": c["actor"],
        "changes": [{"seq": 0, "operation": c["operation"], "object": {"schema": "aid", "name": c["object"], "primary_key": c["pk"]}, "before": image(c["before"]), "after": image(c["after"]), "field_changes": fields}],
    }


def built(spark, c, n=1, max_changes=10_000):
    text = lambda x: None if x is None else json.dumps(x)
    rows = [(i + 1, "aid-1", "mysql", SERVER, "aid", c["object"], text(c["pk"]), c["operation"], text(c["before"]), text(c["after"]), None, None, c["gtid"], "bin.000042", 1152, c["phase"], COMMIT, INGEST, None) for i in range(n)]
    items = normalize.snapshot_identity(normalize.change_items(spark.createDataFrame(rows, SCHEMA), c["names"]))
    fidelity = write({"state": "HEALTHY", "source_config": SOURCE_CONFIG})
    return normalize.events(normalize.transactions(items, max_changes=max_changes), fidelity=F.lit(fidelity), actor=F.lit(write(c["actor"])))


def test_known_events(spark):
    for c in CASES:
        want = plain(c)
        got = built(spark, c).withColumn("row_hash", C.row_hash(F.lit(None).cast("string"), F.col("event_hash"))).collect()
        assert len(got) == 1 and got[0]["core"] == write(want)
        assert got[0]["envelope_id"] == want["envelope_id"] and got[0]["event_hash"] == "sha256:" + sha(write(want))
        assert got[0]["row_hash"] == "sha256:" + sha(C.GENESIS + got[0]["event_hash"])


def test_parts_are_valid_events(spark):
    """A transaction that is too large comes in parts, each with an id of its own that its record accounts for."""
    parts = built(spark, CASES[0], n=5, max_changes=2).orderBy("part").collect()
    assert [(r["part"], r["statement_count"]) for r in parts] == [(0, 2), (1, 2), (2, 1)] and len({r["envelope_id"] for r in parts}) == 3
    records = [(json.dumps({**json.loads(r["core"]), "evidence": {"event_hash": r["event_hash"], "prev_row_hash": None, "row_hash": None}}),) for r in parts]
    assert [r["rules"] for r in validate.validated(spark.createDataFrame(records, "event string")).collect()] == [[], [], []]
    wrong = json.loads(records[1][0])
    wrong["transaction"]["part"] = 0
    wrong["evidence"]["event_hash"] = "sha256:" + sha(write({k: v for k, v in wrong.items() if k != "evidence"}))
    assert validate.validated(spark.createDataFrame([(json.dumps(wrong),)], "event string")).first()["rules"] == ["V3"]


def test_structure(spark):
    """Members the record doesn't know and values of another kind are refused, wherever they stand."""
    good = {**plain(CASES[0]), "evidence": {"event_hash": "sha256:" + sha(write(plain(CASES[0]))), "prev_row_hash": None, "row_hash": None}}
    assert validate.misfit(good, validate.MEMBERS) is None

    def with_(path, value):
        doc = json.loads(json.dumps(good))
        *way, last = path
        at = doc
        for step in way:
            at = at[step]
        at[last] = value
        return doc

    cases = [(["x"], 1, "x"), (["source", "port"], 1, "source.port"), (["transaction", "statement_count"], "1", "transaction.statement_count"), (["transaction", "statement_count"], True, "transaction.statement_count"), (["offset", "gtid"], None, None),
             (["offset", "binlog_pos"], 1.5, "offset.binlog_pos"), (["changes", 0, "field_changes", 0, "old"], [1], None), (["changes", 0, "field_changes", 0, "note"], 1, "changes[0].field_changes[0].note"), (["changes"], {}, "changes"), (["completeness", "gap_detected"], None, "completeness.gap_detected"), (["fidelity", "source_config", "z"], 1, None)]
    for path, value, want in cases:
        assert validate.misfit(with_(path, value), validate.MEMBERS) == want, path
    rows = [(json.dumps(good),), (json.dumps(with_(["x"], 1)),), ("[]",), ("{",), (None,)]
    got = validate.validated(spark.createDataFrame(rows, "event string")).collect()
    assert got[0]["rules"] == [] and got[1]["rules"][0] == "SCHEMA" and got[1]["misfit"] == "x" and all(r["rules"] == ["SCHEMA"] for r in got[2:])
