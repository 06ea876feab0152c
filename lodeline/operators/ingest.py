"""Raw source events to captured records and normalised changes.

Everything is a narrow map: parse once as VARIANT, then Column expressions. A
record that can't be mapped keeps its row with a ``reason``, so that the caller
routes it instead of losing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.canonical import iso_of_millis
from lodeline.functions.changes import key_columns

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def decode_entry(fields: Column) -> Column:
    """struct(key, value) of a flat list of names and values.

    Either there is a field named value (and perhaps key), or the first name is
    the key and its value the value. An odd last name has no value. Of repeated
    names the last counts.
    """
    n = F.floor(F.size(fields) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(fields, i * 2).alias("n"), F.get(fields, i * 2 + 1).alias("v")))
    pairs = F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<n:string,v:string>>"))
    named = lambda name: F.try_element_at(F.filter(pairs, lambda p: p["n"] == name), F.lit(-1))["v"]
    first = F.get(pairs, F.lit(0))["n"]
    first_value = F.try_element_at(F.filter(pairs, lambda p: p["n"] == F.get(pairs, F.lit(0))["n"]), F.lit(-1))["v"]
    has = F.exists(pairs, lambda p: p["n"] == "value")
    return F.struct(F.when(has, named("key")).otherwise(first).alias("key"), F.when(has, named("value")).otherwise(first_value).alias("value"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: the generator keeps the optimiser from copying the expression to where it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def strict_json(text: Column) -> Column:
    """VARIANT of text that is one JSON value and nothing else; null otherwise.

    The parser stops after a value, so the text is read as the only element of a list.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def parsed(raw: DataFrame) -> DataFrame:
    """Adds ``doc``: the unwrapped envelope as VARIANT; null where the value is null or not JSON.

    JSON text of JSON is parsed again; {schema, payload} is unwrapped.
    """
    df = _once(raw, "_v", strict_json(F.col("value_json")))
    again = F.coalesce(strict_json(F.try_variant_get("_v", "$", "string")), F.col("_v"))
    df = _once(df, "_d", F.when(_kind("$", "_v") == "STRING", again).otherwise(F.col("_v"))).drop("_v")
    inner = F.when(_kind("$.payload", "_d") == "STRING", strict_json(F.try_variant_get("_d", "$.payload", "string"))).otherwise(F.try_variant_get("_d", "$.payload", "variant"))
    wrapped = _kind("$.schema", "_d").isNotNull() & _kind("$.payload", "_d").isNotNull()
    return _once(df, "doc", F.when(wrapped, inner).otherwise(F.col("_d"))).drop("_d")


def _kind(path: str, doc: str = "doc") -> Column:
    """Type of a member; null where it is missing, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def _member(path: str) -> Column:
    """struct(kind, text) of a member; objects and arrays have no text."""
    kind = F.regexp_extract(_kind(path), r"^\w+", 0)
    return F.struct(kind.alias("kind"), F.try_variant_get("doc", path, "string").alias("text"))


def snapshot_phase(kind: Column, text: Column) -> Column:
    """Missing, null and false are streaming; last and last_in_data_collection are handoff; else snapshot."""
    off = kind.isNull() | (kind == "VOID") | F.coalesce(F.lower(text) == "false", F.lit(False))
    return F.when(off, "streaming").when(text.isin("last", "last_in_data_collection"), "handoff").otherwise("snapshot")


_MEMBERS = {
    "root": "$", "op": "$.op", "ts": "$.ts_ms", "ddl": "$.ddl", "before": "$.before", "after": "$.after", "source_ts": "$.source.ts_ms", "source_ddl": "$.source.ddl",
    "table": "$.source.table", "db": "$.source.db", "name": "$.source.name", "connector": "$.source.connector", "gtid": "$.source.gtid", "file": "$.source.file",
    "pos": "$.source.pos", "row": "$.source.row", "snapshot": "$.source.snapshot", "uuid": "$.source.server_uuid", "server_id": "$.source.server_id",
}


def captured(raw: DataFrame) -> DataFrame:
    """Raw events as records: class, source metadata, offsets, phase, operation, images, reason.

    raw: delivery_id, topic, stream_id, value_json, received_at. class is
    heartbeat, change (c, u, d or r of a table), or other. reason says why a
    non-heartbeat can't become a change event; it is null for those that can.
    """
    df = _once(parsed(raw), "m", F.struct(*[_member(path).alias(name) for name, path in _MEMBERS.items()]))
    text = lambda name: F.when(F.col(f"m.{name}.kind") == "STRING", F.col(f"m.{name}.text"))
    whole = lambda name: F.when(F.col(f"m.{name}.kind") == "BIGINT", F.col(f"m.{name}.text").try_cast("bigint"))
    is_object = F.coalesce(F.col("m.root.kind") == "OBJECT", F.lit(False))
    table, gtid, op = F.when(text("table") != "", text("table")), text("gtid"), text("op")
    named = F.coalesce(F.contains(F.lower("topic"), F.lit("heartbeat")), F.lit(False))
    heartbeat = named | (is_object & F.col("m.op.kind").isNull() & table.isNull() & F.col("m.ts.kind").isNotNull())
    df = df.select("*", heartbeat.alias("heartbeat"), table.alias("table"), op.alias("op"), F.coalesce(text("ddl"), text("source_ddl")).alias("ddl"))
    operation = F.when(F.col("op").isin("c", "r"), "INSERT").when(F.col("op") == "u", "UPDATE").when(F.col("op") == "d", "DELETE").when(F.col("op") == "t", "TRUNCATE").when(F.col("ddl").isNotNull(), "DDL")
    df = _once(df, "operation", operation)
    uuid = F.coalesce(text("uuid"), F.when(gtid.rlike(UUID), F.split(gtid, ":")[0]))
    engine = F.lower(text("connector"))
    image = lambda name: F.when(F.col(f"m.{name}.kind") == "OBJECT", F.to_json(F.try_variant_get("doc", f"$.{name}", "variant")))
    ts = F.coalesce(whole("source_ts"), whole("ts"))
    reason = (
        F.when(F.col("value_json").isNull(), "no value").when(F.col("doc").isNull(), "not JSON").when(~is_object, "malformed CDC event: value is not an object")
        .when(F.col("operation").isNull(), "unsupported or missing CDC op").when(F.col("table").isNull() & (F.col("operation") != "DDL"), "malformed CDC event: missing source.table")
    )
    return df.select(
        "delivery_id", "topic", "stream_id", "received_at",
        F.when(F.col("heartbeat"), "heartbeat").when(F.col("op").isin("c", "u", "d", "r") & F.col("table").isNotNull(), "change").otherwise("other").alias("class"),
        F.coalesce(text("name"), F.split("topic", r"\.")[0]).alias("db_id"), engine.alias("engine"),
        F.when(engine == "mariadb", F.coalesce(uuid, F.col("m.server_id.text"), F.lit(""))).otherwise(F.coalesce(uuid, F.lit(""))).alias("server_uuid"),
        text("db").alias("schema_name"), F.col("table").alias("object_name"), gtid.alias("gtid"), text("file").alias("binlog_file"),
        F.coalesce(whole("pos"), F.when(text("pos").rlike(r"^\d+$"), text("pos").try_cast("bigint"))).alias("binlog_pos"), whole("row").cast("int").alias("row_no"),
        snapshot_phase(F.col("m.snapshot.kind"), F.col("m.snapshot.text")).alias("snapshot_phase"),
        "operation", ts.alias("ts_ms"), iso_of_millis(ts).alias("commit_ts"), F.col("ddl").alias("ddl_statement"),
        F.when(F.col("operation").isin("UPDATE", "DELETE"), image("before")).alias("before_image"), F.when(F.col("operation").isin("INSERT", "UPDATE"), image("after")).alias("after_image"),
        F.when(~F.col("heartbeat"), reason).alias("reason"),
    )


def with_primary_key(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """Adds ``pk``: JSON object of the key columns, from after on INSERT, else from before.

    Objects that aren't monitored have the key column id. Null where a key
    column isn't in the image, and for DDL and TRUNCATE.
    """
    keys = key_columns(monitored)
    image = F.from_json(F.when(F.col("operation") == "INSERT", F.col("after_image")).otherwise(F.col("before_image")), "map<string,variant>")
    lists: dict[tuple[str, ...], list[str]] = {}
    for name, columns in keys.items():
        lists.setdefault(tuple(columns), []).append(name)
    wanted = None
    for columns, names in lists.items():
        at = F.array(*[F.lit(c) for c in columns])
        wanted = F.when(F.lower("object_name").isin(*names), at) if wanted is None else wanted.when(F.lower("object_name").isin(*names), at)
    wanted = F.array(F.lit("id")) if wanted is None else wanted.otherwise(F.array(F.lit("id")))
    df = changes.withColumn("_image", image).withColumn("_keys", wanted)
    whole = F.forall("_keys", lambda k: F.map_contains_key("_image", k))
    pk = F.when(F.col("operation").isin("INSERT", "UPDATE", "DELETE") & F.col("_image").isNotNull() & whole, F.to_json(F.map_filter("_image", lambda k, v: F.array_contains("_keys", k))))
    return df.withColumn("pk", pk).drop("_image", "_keys")
