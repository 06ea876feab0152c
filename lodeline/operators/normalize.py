"""Normalised changes to canonical transaction events.

changes -> change items (canonical images, diff, mask) -> islands of one
transaction -> events (id, hashes) -> guard (emit, duplicate, violation).
A transaction with a change that has no canonical form is a dead letter.
Only canonical form of open images runs in Python, in one Arrow UDF per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators.ordered import carry

MASK = '"***"'
ROW_OPERATIONS = ("INSERT", "UPDATE", "DELETE")

#: Changes of one event; a larger transaction is cut into numbered parts.
MAX_CHANGES = 10_000

#: Arrivals of one block when looking back over a source's stream.
ARRIVAL_BLOCK = 65_536


def type_label(json_token: Column) -> Column:
    """decimal, int, bool, string, json or null of a JSON token: decimals are strings with a point, and numbers that aren't whole."""
    return (
        F.when(json_token.isNull() | (json_token == "null"), "null").when(json_token.isin("true", "false"), "bool")
        .when(json_token.rlike(r'^"-?\d+\.\d+"$') | json_token.rlike(r"^-?\d+[.E]"), "decimal").when(json_token.startswith('"'), "string")
        .when(json_token.rlike(r"^[\[{]"), "json").otherwise("int")
    )


def sensitive(column: Column, schema: Column, table: Column, names: list[str]) -> Column:
    """Whether schema.table.column, table.column or column is named."""
    if not names:
        return F.lit(False)
    table_column = F.concat_ws(".", table, column)
    return column.isin(*names) | table_column.isin(*names) | F.concat_ws(".", schema, table_column).isin(*names)


def field_changes(before: Column, after: Column, operation: Column, schema: Column, table: Column, names: list[str]) -> Column:
    """Array of struct(path, old, new, data_type, sensitive, masked) by column name; null for DDL and TRUNCATE.

    before and after are maps of JSON tokens. INSERT and DELETE list all
    columns, UPDATE those whose tokens differ (a missing member is null). The
    type is that of the new value, else of the old, taken before masking.
    """
    none = F.create_map().cast("map<string,string>")
    b = F.when(operation != "INSERT", F.coalesce(before, none)).otherwise(none)
    a = F.when(operation != "DELETE", F.coalesce(after, none)).otherwise(none)
    keys = F.array_sort(F.array_union(F.map_keys(b), F.map_keys(a)))
    value = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit("null"))
    changed = F.filter(keys, lambda k: (operation != "UPDATE") | (value(b, k) != value(a, k)))

    def one(k: Column) -> Column:
        old, new, hide = value(b, k), value(a, k), sensitive(k, schema, table, names)
        veil = lambda x: F.when(hide & (x != "null"), F.lit(MASK)).otherwise(x)
        return F.struct(
            k.alias("path"), veil(old).alias("old"), veil(new).alias("new"), type_label(F.when(new != "null", new).otherwise(old)).alias("data_type"),
            hide.alias("sensitive"), hide.alias("masked"),
        )

    return F.when(operation.isin(*ROW_OPERATIONS), F.transform(changed, one))


def masked_image(image: Column, schema: Column, table: Column, names: list[str]) -> Column:
    """A map of tokens with the non-null sensitive ones masked."""
    if not names:
        return image
    return F.transform_values(image, lambda k, v: F.when(sensitive(k, schema, table, names) & (v != "null"), F.lit(MASK)).otherwise(v))


def change_items(changes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds fields (array of field changes), item (canonical change item without its seq) and error.

    Needs operation, schema_name, object_name, pk, before_image, after_image
    (JSON text) and ddl_statement, ddl_effect. error is why an image has no
    canonical form (floats, unsafe integers, clashing names, invalid JSON, no object).
    """
    names = names or []
    df = changes
    for name, source in (("_b", "before_image"), ("_a", "after_image"), ("_k", "pk")):
        df = df.withColumn(name, C.canonical(F.col(source)))
    schema, table, op = F.col("schema_name"), F.col("object_name"), F.col("operation")
    df = df.withColumn("fields", field_changes(F.col("_b.members"), F.col("_a.members"), op, schema, table, names))
    field = F.transform("fields", lambda f: C.obj({
        "path": F.concat(F.lit("["), C.json_string(f["path"]), F.lit("]")), "old": f["old"], "new": f["new"], "data_type": C.token(f["data_type"]),
        "changed": F.lit("true"), "sensitive": f["sensitive"].cast("string"), "masked": F.when(f["masked"], "true"),
    }, {"masked"}))
    target = C.obj({"schema": C.token(schema), "name": C.token(table), "primary_key": F.col("_k.text")}, {"primary_key"})
    ddl = F.when(op == "DDL", C.obj({"statement": C.token(F.coalesce("ddl_statement", F.lit(""))), "effect": C.json_string(F.col("ddl_effect"))}, {"effect"}))
    image = lambda name: C.image_object(masked_image(F.col(f"{name}.members"), schema, table, names))
    members = {"operation": C.token(op), "object": target, "before": image("_b"), "after": image("_a"), "field_changes": F.when(F.col("fields").isNotNull(), C.arr(field)), "ddl": ddl}
    item = C.obj(members, {"field_changes", "ddl"})
    shapeless = lambda name: F.when(F.col(f"{name}.members").isNull() & (F.col(f"{name}.text") != "null"), "not an object")
    error = F.coalesce("_b.error", "_a.error", "_k.error", shapeless("_b"), shapeless("_a"))
    # the item stays open: its seq, the last member by name, is known when the transaction is complete
    return df.withColumn("item", F.regexp_replace(item, r"\}$", "")).withColumn("pk_text", F.col("_k.text")).withColumn("error", error).drop("_b", "_a", "_k")


def islands(changes: DataFrame, source: str = "db_id", arrival: str = "change_id", key: str = "tx_id") -> DataFrame:
    """Adds ``island``: the arrival number of the first change of each run of one key.

    Consecutive changes of a source with an equal key are one transaction; a
    change of the key closes it, and when the key comes back a new one begins.
    Changes with a null key stand alone. Runs are found block by block, so no
    source is sorted in one task.
    """
    df = changes.withColumn("_block", F.floor(F.col(arrival) / ARRIVAL_BLOCK).cast("bigint"))
    df = carry(df, [source], "_block", [arrival], {"_prev": F.struct(F.col(key).alias("k"))})
    opens = F.col("_prev").isNull() | F.col(key).isNull() | ~F.col("_prev.k").eqNullSafe(F.col(key))
    df = df.withColumn("_opens", F.when(opens, F.col(arrival)))
    return carry(df, [source], "_block", [arrival], {"island": F.col("_opens")}, inclusive=True).drop("_block", "_prev", "_opens")


def offset_object() -> Column:
    text = lambda name: C.token(F.col(name))
    return C.obj({"gtid": text("gtid"), "binlog_file": text("binlog_file"), "binlog_pos": C.token(F.col("binlog_pos"), "number"), "lsn": F.lit("null"), "scn": F.lit("null"), "resume_token": F.lit("null")})


def snapshot_identity(changes: DataFrame) -> DataFrame:
    """Adds epoch_id and tx_id: changes without a GTID are identified by their snapshot epoch and row."""
    start = F.coalesce("commit_iso", "ingest_iso")
    epoch = C.snapshot_epoch_id(F.col("db_id"), F.col("server_uuid"), F.coalesce("binlog_file", F.lit("")), F.coalesce("binlog_pos", F.lit(0)), start)
    df = changes.withColumn("epoch_id", F.when(F.coalesce("gtid", F.lit("")) == "", epoch))
    return df.withColumn("tx_id", F.when(F.col("epoch_id").isNull(), F.col("gtid")).otherwise(C.snapshot_tx_id(F.col("epoch_id"), F.col("schema_name"), F.col("object_name"), F.col("pk_text"))))


def gtid_islands(changes: DataFrame, arrival: str = "change_id") -> DataFrame:
    """Adds ``island`` by GTID where there is one. Best done before the items are built, as they are larger than what they are built of."""
    return islands(changes.withColumn("_key", F.when(F.col("gtid") != "", F.col("gtid"))), arrival=arrival, key="_key").drop("_key")


def transactions(items: DataFrame, arrival: str = "change_id", max_changes: int = MAX_CHANGES) -> DataFrame:
    """One row per transaction and part: metadata of its first change and its items in order of arrival.

    A transaction of more than max_changes changes comes in parts 0, 1, ...; part
    is null for all others. Changes whose epoch_id isn't null stand alone.
    errors (change_id, error) are the part's changes without a canonical form;
    refused says whether any part of the transaction has one.
    """
    runs = items if "island" in items.columns else gtid_islands(items, arrival)
    order = Window.partitionBy("db_id", "island").orderBy(arrival)
    runs = runs.withColumn("_n", F.row_number().over(order) - 1).withColumn("_part", F.floor(F.col("_n") / max_changes).cast("int"))
    first = ["engine", "server_uuid", "schema_name", "engine_version", "tx_id", "epoch_id", "gtid", "binlog_file", "binlog_pos", "snapshot_phase", "commit_iso", "ingest_iso"]
    grouped = runs.groupBy("db_id", "island", "_part").agg(
        F.min_by(F.struct(*first), "_n").alias("first"),
        F.array_sort(F.collect_list(F.struct("_n", "item", "operation", "schema_name", "object_name", "pk_text"))).alias("changes"),
        F.count(F.lit(1)).alias("statement_count"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(F.col(arrival).alias("change_id"), "error")))).alias("errors"),
    )
    refused = F.max(F.size("errors") > 0).over(Window.partitionBy("db_id", "island")).alias("refused")
    full = (F.col("_part") > 0) | (F.col("statement_count") == max_changes)
    return grouped.select("db_id", "island", F.when(full, F.col("_part")).alias("part"), "first.*", "changes", "statement_count", "errors", refused)


def tables_of(grouped: DataFrame) -> DataFrame:
    """Adds tables, the distinct tables of each transaction in order of their first change, and operations, one for each change."""
    return grouped.withColumn("tables", F.array_distinct(F.transform("changes", lambda c: c["object_name"]))).withColumn("operations", F.transform("changes", lambda c: c["operation"]))


def outcomes(routed: DataFrame, by: list[str] | None = None, outcome: str = "outcome") -> DataFrame:
    """Pipeline statistics: how many of each outcome, in all or by the columns named."""
    return routed.groupBy(*(by or []), outcome).agg(F.count(F.lit(1)).alias("n"))


def unattested_fidelity(completeness_known: Column | None = None) -> Column:
    """Fidelity of an event nothing attests: degraded, with the reasons."""
    notes = '["completeness not attested"]'
    bare = '{"degraded_reason":"no fidelity attestation available",%s"source_config":{"config_snapshot_id":"unattested"},"state":"DEGRADED"}'
    without = F.lit(bare % f'"notes":{notes},')
    return without if completeness_known is None else F.when(completeness_known, F.lit(bare % "")).otherwise(without)


def default_completeness() -> Column:
    """What is known of a transaction from itself: its key, phase and epoch."""
    key = F.when(F.col("epoch_id").isNull(), F.col("tx_id")).otherwise(C.snapshot_offset_key(F.col("epoch_id")))
    return C.obj({"consumed_offset_key": C.token(key), "gap_detected": F.lit("false"), "snapshot_phase": C.token(F.col("snapshot_phase")), "snapshot_epoch_id": C.json_string(F.col("epoch_id"))}, {"snapshot_epoch_id"})


UNATTRIBUTED = '{"attribution_confidence":"unattributed"}'


def events(grouped: DataFrame, fidelity: Column | None = None, completeness: Column | None = None, actor: Column | None = None) -> DataFrame:
    """Canonical events: envelope_id, schema_version, core (canonical JSON without evidence), event_hash.

    fidelity, completeness and actor are canonical tokens; left out, they say
    what is known of an event nothing attests. Refused transactions give none;
    they are ``dead_letters``.
    """
    return attempted(grouped, fidelity, completeness, actor).where(~F.col("refused")).drop("errors", "refused")


def attempted(grouped: DataFrame, fidelity: Column | None = None, completeness: Column | None = None, actor: Column | None = None) -> DataFrame:
    """``events`` with the refused transactions left in, which have neither id nor core nor hash."""
    fidelity = unattested_fidelity(F.col("epoch_id").isNotNull()) if fidelity is None else fidelity
    completeness = default_completeness() if completeness is None else completeness
    actor = F.lit(UNATTRIBUTED) if actor is None else actor
    version = F.when(F.coalesce("gtid", F.lit("")) != "", "cce-1.0").otherwise("cce-1.1")
    plain = C.envelope_id(F.col("db_id"), F.col("tx_id"), F.col("server_uuid"))
    parted = C.envelope_id(F.col("db_id"), F.col("tx_id"), F.col("server_uuid"), F.col("part").cast("string"))
    df = grouped.withColumn("envelope_id", F.when(F.col("part").isNull(), plain).otherwise(parted)).withColumn("schema_version", version)
    items = F.transform("changes", lambda c, i: F.concat(c["item"], F.lit(',"seq":'), i.cast("string"), F.lit("}")))
    source = C.obj({"db_id": C.token(F.col("db_id")), "engine": C.token(F.col("engine")), "server_uuid": C.token(F.col("server_uuid")), "schema": C.token(F.col("schema_name")), "engine_version": C.json_string(F.col("engine_version"))}, {"engine_version"})
    tx = C.obj({"tx_id": C.token(F.col("tx_id")), "commit_ts": C.token(F.coalesce("commit_iso", "ingest_iso")), "ingest_ts": C.token(F.col("ingest_iso")), "statement_count": F.size("changes").cast("string"), "part": F.col("part").cast("string")}, {"part"})
    core = C.obj({
        "schema_version": C.token(F.col("schema_version")), "envelope_id": C.token(F.col("envelope_id")), "kind": F.lit('"transaction"'), "source": source, "transaction": tx,
        "offset": offset_object(), "fidelity": fidelity, "completeness": completeness, "actor": actor, "changes": C.arr(items),
    })
    df = df.withColumn("core", F.when(~F.col("refused"), core)).withColumn("event_hash", C.sha(F.col("core")))
    return df.withColumn("envelope_id", F.when(~F.col("refused"), F.col("envelope_id")))


def dead_letters(grouped: DataFrame) -> DataFrame:
    """One row per refused transaction, whatever its parts: db_id, island, statement_count, failure_reason (the first change's), change_ids."""
    whole = grouped.where("refused").groupBy("db_id", "island").agg(F.sum("statement_count").alias("statement_count"), F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))
    reason = F.concat(F.lit("serialization failed: "), F.col("errors")[0]["error"])
    return whole.select("db_id", "island", "statement_count", reason.alias("failure_reason"), F.col("errors.change_id").alias("change_ids"))


def prepared(changes: DataFrame, sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """normalized_change rows joined to their source and ready to be grouped: items, tx_id, epoch_id, times as text."""
    dimension = sources.select("db_id", "server_uuid")
    df = changes.join(dimension, "db_id", "left").select(
        "change_id", "db_id", "engine", F.coalesce("server_uuid", F.lit("")).alias("server_uuid"), "schema_name", "object_name",
        F.col("primary_key").alias("pk"), "operation", "before_image", "after_image", "ddl_statement", "ddl_effect", "gtid", "binlog_file", "binlog_pos", "snapshot_phase",
        C.iso_ms(F.col("commit_ts")).alias("commit_iso"), C.iso_ms(F.col("ingest_ts")).alias("ingest_iso"), F.lit(None).cast("string").alias("engine_version"), *(["island"] if "island" in changes.columns else []),
    )
    return snapshot_identity(change_items(df, names))


def guarded(built: DataFrame, arrival: str = "island") -> DataFrame:
    """Adds outcome: EMIT for the first arrival of an id, DUPLICATE for later ones with its hash, INTEGRITY_VIOLATION for others.

    The first hash of an id is an aggregate, joined back by id; ids are unique
    but for repeats, and map-side aggregation takes these in before the shuffle.
    """
    first = built.groupBy("envelope_id").agg(F.min_by(F.struct(F.col("event_hash").alias("hash"), F.col("db_id"), F.col(arrival).alias("n")), F.struct("db_id", arrival)).alias("first"))
    joined = built.join(first, "envelope_id")
    is_first = (F.col("first.db_id") == F.col("db_id")) & (F.col("first.n") == F.col(arrival))
    outcome = F.when(is_first, "EMIT").when(F.col("first.hash") == F.col("event_hash"), "DUPLICATE").otherwise("INTEGRITY_VIOLATION")
    return joined.withColumn("outcome", outcome).drop("first")


def late_ingests(built: DataFrame, source: str = "db_id", arrival: str = "change_id", ingest: str = "ingest_iso") -> DataFrame:
    """Rows whose ingest time, compared as text, is before the greatest one that arrived earlier from their source; nulls neither raise it nor are late."""
    df = built.withColumn("_block", F.floor(F.col(arrival) / ARRIVAL_BLOCK).cast("bigint"))
    inside = Window.partitionBy(source, "_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(source, "_block").agg(F.max(ingest).alias("_top")).select(source, "_block", F.max("_top").over(across).alias("_over"))
    df = df.withColumn("_in", F.max(ingest).over(inside)).join(blocks, [source, "_block"])
    return df.withColumn("greatest", F.greatest("_in", "_over")).where(F.col(ingest) < F.col("greatest")).drop("_block", "_in", "_over")


#: Hard keys of attribution: the event's column and the audit's.
HARD_KEYS = ("connection_id", "thread_id", "gtid")


def attributed(events_: DataFrame, audits: DataFrame, window_ms: int = 5000) -> DataFrame:
    """Adds confidence (exact, probable, unattributed), audit_event_id and candidates of each event.

    events_: envelope_id, db_id, commit_ms, tables (array) and any of connection_id,
    thread_id, gtid. audits: audit_event_id, db_id, event_ms, objects (array of
    table names, null or empty for any), the same keys, tampered. A candidate is
    an audit of the database inside the window, about one of the event's tables
    or about any. Exact: one candidate agrees on a hard key; else probable: there
    is one candidate. A tampered audit in the window attributes nothing.

    Nothing is paired that isn't about the same thing: hard keys are an equi-join.
    How many candidates there are is counted, not listed: those about any table
    by the database, those about tables by database and table, each as a number of
    audits up to a time, so an event looks up two numbers for each.
    """
    keys = [k for k in HARD_KEYS if k in events_.columns and k in audits.columns]
    bucket = lambda ms: F.floor(ms / window_ms).cast("bigint")
    clean = audits.select("audit_event_id", F.col("db_id").alias("_db"), "event_ms", "objects", *[F.col(k).alias(f"a_{k}") for k in keys], F.coalesce("tampered", F.lit(False)).alias("tampered")).where(F.col("event_ms").isNotNull())
    about = F.when(F.coalesce(F.size("objects"), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct("objects"))
    slices = clean.select("_db", "audit_event_id", "event_ms", F.size(about).alias("_wide"), F.explode(about).alias("_table"))
    asked = F.array_union(F.coalesce("tables", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    each = events_.select("envelope_id", "db_id", "commit_ms", F.size(asked).alias("_asks"), F.explode(asked).alias("_table"))
    # an event of several tables would count an audit of several twice: these few are listed, by table and bucket, and made distinct
    one_of, several = slices.where("_wide = 1"), slices.where("_wide > 1")
    parts = [_near(each, one_of, window_ms), _near(each.where("_asks <= 2"), several, window_ms)]
    listed = each.where("_asks > 2").select("envelope_id", "db_id", "commit_ms", "_table", F.explode(F.array(*[bucket(F.col("commit_ms")) + d for d in (-1, 0, 1)])).alias("_b"))
    listed = listed.join(several.select(F.col("_db").alias("db_id"), "_table", bucket(F.col("event_ms")).alias("_b"), "event_ms", "audit_event_id"), ["db_id", "_table", "_b"]).where(F.abs(F.col("event_ms") - F.col("commit_ms")) <= window_ms)
    listed = listed.select(F.col("envelope_id").cast("string").alias("envelope_id"), "audit_event_id").distinct().groupBy("envelope_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.min("audit_event_id")).alias("one"))
    counted = parts[0].unionByName(parts[1]).unionByName(listed).groupBy("envelope_id").agg(F.sum("n").alias("n"), F.max("one").alias("one"))
    dirty = _near(events_.select("envelope_id", "db_id", "commit_ms", F.lit(None).cast("string").alias("_table")), clean.where("tampered").select("_db", "audit_event_id", "event_ms", F.lit(None).cast("string").alias("_table")), window_ms)
    out = events_.join(counted.select("envelope_id", F.col("n").alias("candidates"), F.col("one").alias("one_id")), "envelope_id", "left").join(dirty.select("envelope_id", (F.col("n") > 0).alias("tampered")), "envelope_id", "left")
    keyed = None
    for k in keys:
        side = events_.where(F.col(k).isNotNull()).select("envelope_id", "db_id", "commit_ms", "tables", F.col(k).alias("_k"), F.explode(F.array(*[bucket(F.col("commit_ms")) + d for d in (-1, 0, 1)])).alias("_b"))
        hit = side.join(clean.where(F.col(f"a_{k}").isNotNull()).select("_db", "audit_event_id", "event_ms", "objects", F.col(f"a_{k}").alias("_ak"), bucket(F.col("event_ms")).alias("_ab")), (F.col("db_id") == F.col("_db")) & (F.col("_k") == F.col("_ak")) & (F.col("_b") == F.col("_ab")))
        hit = hit.where((F.abs(F.col("event_ms") - F.col("commit_ms")) <= window_ms) & ((F.coalesce(F.size("objects"), F.lit(0)) < 1) | F.coalesce(F.arrays_overlap("objects", "tables"), F.lit(False)))).select("envelope_id", "audit_event_id")
        keyed = hit if keyed is None else keyed.unionByName(hit)
    if keyed is not None:
        one = keyed.groupBy("envelope_id").agg((F.min("audit_event_id") == F.max("audit_event_id")).alias("keyed"), F.min("audit_event_id").alias("key_id"))
        out = out.join(one, "envelope_id", "left")
    else:
        out = out.withColumn("keyed", F.lit(False)).withColumn("key_id", F.lit(None))
    trusted = ~F.coalesce("tampered", F.lit(False))
    exact, probable = trusted & F.coalesce("keyed", F.lit(False)), trusted & (F.col("candidates") == 1)
    return out.withColumn("confidence", F.when(exact, "exact").when(probable, "probable").otherwise("unattributed")).withColumn(
        "audit_event_id", F.when(exact, F.col("key_id")).when(probable, F.col("one_id"))
    ).withColumn("candidates", F.coalesce("candidates", F.lit(0))).drop("keyed", "tampered", "key_id", "one_id")


def _near(each: DataFrame, slices: DataFrame, window_ms: int) -> DataFrame:
    """(envelope_id, n, one): how many audits of the same database and table are within the window of an event, and which one if it is one.

    Both sides are one timeline per database and table, cut into buckets of the
    window's width. Inside a bucket the audits are numbered in their order; the
    audits within the window are then a run of numbers in three buckets.
    """
    bucket = lambda ms: F.floor(ms / window_ms).cast("bigint")
    table = lambda c: F.coalesce(F.concat(F.lit("t:"), c), F.lit("*"))
    a = slices.select(F.col("_db").alias("db_id"), table(F.col("_table")).alias("_t"), bucket(F.col("event_ms")).alias("_b"), "event_ms", "audit_event_id")
    asks = each.select("envelope_id", "db_id", table(F.col("_table")).alias("_t"), "commit_ms", bucket(F.col("commit_ms")).alias("_c"))
    # an event asks its own bucket and both beside it: of the one before for audits from commit - window on, of the one after for those up to commit + window
    asks = asks.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_b", F.col("_c") + F.col("_d"))
    line = a.select("db_id", "_t", "_b", F.col("event_ms").alias("_at"), F.lit(1).alias("_side"), "audit_event_id", F.lit(None).cast("string").alias("envelope_id"), F.lit(0).alias("_d")).unionByName(
        asks.select("db_id", "_t", "_b", F.when(F.col("_d") < 0, F.col("commit_ms") - window_ms).when(F.col("_d") > 0, F.col("commit_ms") + window_ms).otherwise(F.lit(None).cast("bigint")).alias("_at"), F.when(F.col("_d") < 0, 0).otherwise(2).alias("_side"), F.lit(None).cast(a.schema["audit_event_id"].dataType).alias("audit_event_id"), F.col("envelope_id").cast("string").alias("envelope_id"), "_d")
    )
    # audits at the very edge count on both sides; a question of the own bucket comes after all of its audits
    here = Window.partitionBy("db_id", "_t", "_b").orderBy(F.col("_at").asc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("db_id", "_t", "_b")
    first = F.col("_side") == 1
    df = line.select("*", F.count_if(first).over(here).alias("_upto"), F.count_if(first).over(whole).alias("_all"), F.last(F.when(first, F.col("audit_event_id")), ignorenulls=True).over(here).alias("_last"), F.max(F.when(first, F.struct("_at", "audit_event_id"))).over(whole).alias("_top"))
    n = F.when(F.col("_d") < 0, F.col("_all") - F.col("_upto")).otherwise(F.col("_upto"))
    # if a question finds one audit: the last of its bucket for the side before, else the only one up to it
    one = F.when(F.col("_d") < 0, F.col("_top.audit_event_id")).otherwise(F.col("_last"))
    found = df.where(F.col("envelope_id").isNotNull()).select("envelope_id", n.alias("n"), F.when(n == 1, one).alias("one"))
    return found.groupBy("envelope_id").agg(F.sum("n").alias("n"), F.max("one").alias("one"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], block_ms: int = 86_400_000) -> DataFrame:
    """Adds the right side's columns as of each left row: those of the latest right row with an equal key and a time not after it.

    Both sides are laid into one timeline, cut into blocks of ``block_ms`` (ts is in ms);
    at equal times the right side counts, of right rows at one time any one. Left rows without a match get
    nulls, as have those with null keys or times.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("_l"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_t"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_t"), F.struct(*columns).alias("_r"))
    k = [f"_k{i}" for i in range(len(keys))]
    both = a.unionByName(b)
    ok = F.col("_t").isNotNull()
    for x in k:
        ok = ok & F.col(x).isNotNull()
    line = both.where(ok).select("*", F.floor(F.col("_t") / block_ms).cast("bigint").alias("_block"), F.struct(F.col("_t").alias("t"), F.col("_r").isNull().alias("left"), F.monotonically_increasing_id().alias("n")).alias("_at"))
    found = carry(line, k, "_block", ["_at"], {"_got": F.col("_r")}, inclusive=True).where(F.col("_l").isNotNull())
    out = found.select("_l.*", *[F.col(f"_got.{c}").alias(c) for c in columns])
    lost = both.where(~ok & F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns])
    return out.unionByName(lost)
