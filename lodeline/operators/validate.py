"""Validation of canonical events: every broken rule of a record, as columns.

Structure and state are checked in one pass over a typed reading of the JSON;
only the recomputed hash needs the canonical form. A record is valid if it has
no broken rule.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions import canonical as C

SCHEMA = (
    "schema_version string, envelope_id string, kind string, source struct<db_id:string,engine:string,server_uuid:string,schema:string>,"
    " transaction struct<tx_id:string,commit_ts:string,ingest_ts:string,statement_count:bigint,part:int>,"
    " offset struct<gtid:string,binlog_file:string,binlog_pos:bigint,lsn:string,scn:string,resume_token:string>, fidelity struct<state:string,degraded_reason:string>,"
    " completeness struct<consumed_offset_key:string,gap_detected:boolean,snapshot_phase:string,snapshot_epoch_id:string,snapshot_coverage:struct<status:string,expected_rows:bigint>>,"
    " actor struct<attribution_confidence:string,audit_event_ref:string>,"
    " changes array<struct<seq:bigint,operation:string,object:struct<schema:string,name:string,primary_key:string>,before:string,after:string,field_changes:array<struct<path:array<string>,changed:boolean,data_type:string>>,ddl:string>>,"
    " evidence struct<event_hash:string,prev_row_hash:string,row_hash:string,anchor_ref:struct<hsm_signature:string,tsa_token:string>>"
)

#: Fixed values of the record.
VERSIONS = ("cce-1.0", "cce-1.1")
ENGINES = ("mysql", "mariadb", "postgres", "sqlserver", "oracle", "mongodb")
STATES = ("HEALTHY", "DEGRADED", "COMPROMISED")
CONFIDENCES = ("exact", "probable", "unattributed")
REAL_KEYS = ("gtid", "lsn", "scn", "resume_token")
ROW_OPERATIONS = ("INSERT", "UPDATE", "DELETE")


#: The record's members and the kinds of their values (text, whole, truth, any; ``?`` or null; ``[]`` a list of it; a dict a closed object, OPEN an open one).
OPEN = "open"
MEMBERS = {
    "schema_version": "text", "envelope_id": "text", "kind": "text",
    "source": {"db_id": "text", "engine": "text", "engine_version": "text", "server_uuid": "text", "schema": "text"},
    "transaction": {"tx_id": "text", "commit_ts": "text", "ingest_ts": "text", "statement_count": "whole", "part": "whole"},
    "offset": {"gtid": "text?", "binlog_file": "text?", "binlog_pos": "whole?", "lsn": "text?", "scn": "text?", "resume_token": "text?"},
    "fidelity": {"state": "text", "source_config": OPEN, "notes": ["text"], "degraded_reason": "text"},
    "completeness": {
        "consumed_offset_key": "text", "consumed_gtid_set": "text", "heartbeat_ts": "text", "gap_detected": "truth", "snapshot_phase": "text", "snapshot_epoch_id": "text",
        "snapshot_coverage": {"epoch_id": "text", "table": "text", "expected_rows": "whole?", "expected_is_estimate": "truth", "emitted_rows": "whole", "status": "text"},
    },
    "actor": {"db_user": "text?", "client_host": "text?", "connection_id": "text?", "application_name": "text?", "attribution_confidence": "text", "audit_event_ref": "text", "correlation_basis": ["text"]},
    "changes": [{
        "seq": "whole", "operation": "text", "object": {"schema": "text", "name": "text", "primary_key": OPEN}, "before": "open?", "after": "open?", "ddl": OPEN,
        "field_changes": [{"path": ["text"], "old": "any", "new": "any", "data_type": "text", "changed": "truth", "sensitive": "truth", "masked": "truth", "array_op": "text"}],
    }],
    "evidence": {"event_hash": "text", "prev_row_hash": "text?", "row_hash": "text?", "worm_object_key": "text", "segment_id": "text", "anchor_ref": "open?"},
}

_KINDS = {"text": str, "whole": int, "truth": bool, "open": dict}


def misfit(value, kind, path: str = "") -> str | None:
    """Path of the first member that the record doesn't know or whose value is of another kind; null if there is none. Members may be missing: that is for the rules."""
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            return path or "record"
        for name, x in value.items():
            at = f"{path}.{name}" if path else name
            found = at if name not in kind else misfit(x, kind[name], at)
            if found:
                return found
        return None
    if isinstance(kind, list):
        if not isinstance(value, list):
            return path
        return next((found for i, x in enumerate(value) if (found := misfit(x, kind[0], f"{path}[{i}]"))), None)
    if kind == "any" or (value is None and kind.endswith("?")):
        return None
    own = _KINDS[kind.rstrip("?")]
    return None if isinstance(value, own) and not (own is int and isinstance(value, bool)) else path


@F.pandas_udf(T.StringType())
def structure(events: pd.Series) -> pd.Series:
    """``misfit`` of each event; ``unreadable`` for text that isn't JSON."""

    def one(text):
        try:
            return misfit(json.loads(text), MEMBERS)
        except (ValueError, TypeError, RecursionError):
            return "unreadable"

    return pd.Series([one(t) for t in events], dtype=object)


@F.pandas_udf(T.StringType())
def core_hash(events: pd.Series) -> pd.Series:
    """Hash token of each event's canonical form without its evidence; null where it has none."""
    import hashlib

    def one(text):
        try:
            doc = json.loads(text)
            doc.pop("evidence", None)
            return "sha256:" + hashlib.sha256(C.canonical_text(json.dumps(doc)).encode()).hexdigest()
        except (ValueError, TypeError, AttributeError, RecursionError):
            return None

    return events.map(one)


def object_kind(content: Column) -> Column:
    """What a sealed object is, by its member kind: cce, epoch_manifest, or null for anything else."""
    kind = F.get_json_object(content, "$.kind")
    return F.when(kind == "transaction", "cce").when(kind == "snapshot_epoch_manifest", "epoch_manifest")


def version_gate(version: Column) -> Column:
    """VERSION_MAJOR for a major version other than 1 or text that is no version; else null."""
    return F.when(~F.coalesce(version.rlike(r"^cce-1\.\d+$"), F.lit(False)), "VERSION_MAJOR")


def _stated(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def broken_rules() -> Column:
    """Array of the rules a record (column ``e``, with ``_hash`` beside it) breaks, in their order."""
    e = F.col("e")
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))  # noqa: E731 - what can't be judged is broken
    changes = F.coalesce(e["changes"], F.array().cast(T.ArrayType(_changes_type())))
    every = lambda test: F.forall(changes, test)
    is_row = lambda c: F.coalesce(c["operation"].isin(*ROW_OPERATIONS), F.lit(False))
    has = lambda x: x.isNotNull() & (x != "null")

    def nullity(c: Column) -> Column:
        b, a = has(c["before"]), has(c["after"])
        op = c["operation"]
        right = F.when(op == "INSERT", ~b & a).when(op == "UPDATE", b & a).when(op == "DELETE", b & ~a).when(op.isin("DDL", "TRUNCATE"), ~b & ~a).otherwise(False)
        return F.coalesce(right & (~is_row(c) | c["field_changes"].isNotNull()), F.lit(False))

    seqs = F.forall(F.transform(changes, lambda c, i: c["seq"].eqNullSafe(i.cast("bigint"))), lambda ok: ok)
    pk = lambda c: ~is_row(c) | F.coalesce(c["object"]["primary_key"].rlike(r'^\{\s*"'), F.lit(False))
    typed = lambda c: F.forall(F.coalesce(c["field_changes"], F.array().cast(_fields_type())), lambda f: (F.size(f["path"]) > 0) & f["changed"].isNotNull() & f["data_type"].isNotNull())
    offset, phase, coverage = e["offset"], e["completeness"]["snapshot_phase"], e["completeness"]["snapshot_coverage"]
    real = F.lit(False)
    empty_key = F.lit(False)
    for k in REAL_KEYS:
        real = real | _stated(offset[k])
        empty_key = empty_key | F.coalesce(offset[k] == "", F.lit(False))
    binlog = _stated(offset["binlog_file"]) & F.coalesce(offset["binlog_pos"] >= 0, F.lit(False))
    binlog_only = (e["schema_version"] == "cce-1.1") & e["source"]["engine"].isin("mysql", "mariadb") & phase.isin("snapshot", "handoff") & binlog
    snapshot = F.coalesce(phase.isin("snapshot", "handoff"), F.lit(False))
    first = F.get(changes, F.lit(0))["object"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    epoch = C.snapshot_epoch_id(blank(e["source"]["db_id"]), blank(e["source"]["server_uuid"]), blank(offset["binlog_file"]), F.coalesce(offset["binlog_pos"], F.lit(0)), blank(e["transaction"]["commit_ts"]))
    given = e["completeness"]["snapshot_epoch_id"]
    identity = (given == epoch) & (e["completeness"]["consumed_offset_key"] == C.snapshot_offset_key(given)) & (first.isNull() | (e["transaction"]["tx_id"] == C.snapshot_tx_id(given, first["schema"], first["name"], F.col("_pk"))))
    covered = coverage.isNotNull() & (coverage["expected_rows"].isNull() | coverage["status"].isin("incomplete", "interrupted"))
    evidence = e["evidence"]
    ids = (e["source"]["db_id"], e["transaction"]["tx_id"], e["source"]["server_uuid"])
    row = C.row_hash(evidence["prev_row_hash"], evidence["event_hash"])
    anchor = evidence["anchor_ref"]
    return F.array_compact(F.array(
        version_gate(e["schema_version"]),
        rule("V1", ~e["schema_version"].isin(*VERSIONS)),
        rule("V2", e["kind"] != "transaction"),
        # a part of a large transaction has an id of its own
        rule("V3", e["envelope_id"] != F.when(e["transaction"]["part"].isNull(), C.envelope_id(*ids)).otherwise(C.envelope_id(*ids, e["transaction"]["part"].cast("string")))),
        rule("V4", ~seqs | (e["transaction"]["statement_count"] != F.size(changes))),
        rule("V5", ~every(nullity)),
        rule("V6", ~every(pk)),
        rule("V7", ~every(typed)),
        rule("V8", ~e["fidelity"]["state"].isin(*STATES) | ((e["fidelity"]["state"] != "HEALTHY") & ~_stated(e["fidelity"]["degraded_reason"]))),
        rule("V9", e["completeness"]["consumed_offset_key"].isNull() | e["completeness"]["gap_detected"].isNull()),
        rule("V10", ~e["actor"]["attribution_confidence"].isin(*CONFIDENCES) | ((e["actor"]["attribution_confidence"] != "unattributed") & ~_stated(e["actor"]["audit_event_ref"]))),
        rule("V11", empty_key | (~real & ~binlog)),
        rule("V12", ~F.col("_hash").eqNullSafe(evidence["event_hash"]) | (evidence["prev_row_hash"].isNotNull() & evidence["row_hash"].isNotNull() & (row != evidence["row_hash"]))),
        rule("V13", anchor.isNotNull() & (anchor["hsm_signature"].isNull() | anchor["tsa_token"].isNull())),
        rule("V16", ~real & ~F.coalesce(binlog_only, F.lit(False))),
        rule("V17", snapshot & ~F.coalesce(identity, F.lit(False))),
        rule("V18", covered & ((e["fidelity"]["state"] == "HEALTHY") | ~_stated(e["fidelity"]["degraded_reason"]))),
    ))


def _changes_type() -> T.DataType:
    return _types()["changes"].dataType.elementType


def _fields_type() -> T.DataType:
    return next(f.dataType for f in _changes_type().fields if f.name == "field_changes")


def _types() -> T.StructType:
    return T._parse_datatype_string(SCHEMA)


def validated(records: DataFrame, event: str = "event") -> DataFrame:
    """Adds ``rules``, the broken rules of the JSON in column ``event``, and ``misfit``.

    Text that isn't a JSON object breaks SCHEMA alone; a member that the record
    doesn't know, or whose value is of another kind, breaks it too (misfit is its path).
    """
    df = records.withColumn("e", F.from_json(event, SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_hash", core_hash(F.col(event))).withColumn("misfit", structure(F.col(event)))
    df = df.withColumn("_pk", C.canonical(F.get(F.col("e.changes"), F.lit(0))["object"]["primary_key"])["text"])
    readable = F.coalesce(F.col(event).rlike(r"^\s*\{"), F.lit(False)) & F.col("e").isNotNull() & F.col("_hash").isNotNull()
    odd = F.when(F.col("misfit").isNotNull(), F.array(F.lit("SCHEMA"))).otherwise(F.array().cast("array<string>"))
    return df.select(*records.columns, F.when(readable, F.concat(odd, broken_rules())).otherwise(F.array(F.lit("SCHEMA"))).alias("rules"), "misfit")
