"""The driver's tables as inputs of the audit operators.

``events`` is a change stream: arrival order is event_id, four databases, one
GTID per event, every 97th number of a database lost and every 50th event
delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators.ordered import numbered
from lodeline.session import read_table

SERVER = "3e11fa47-71ca-11e1-9e33-c80aa942956"
EVENT_BLOCK = 65_536


def stream(spark: SparkSession, root: str) -> DataFrame:
    """Events as a change stream: event_id, ts, user_id, event_type, value_text, db_id, seq, gtid, op."""
    e = read_table(spark, root, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("value_text"), F.concat(F.lit("db-"), F.col("user_id") % 4).alias("db_id"),
        F.floor(F.col("event_id") / EVENT_BLOCK).cast("bigint").alias("_block"),
    )
    e = numbered(e, ["db_id"], "_block", ["event_id"], "_n").drop("_block")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type").isin("click", "purchase"), "UPDATE").when(F.col("event_type") == "error", "DELETE").otherwise("READ")
    return e.withColumn("seq", F.col("_n") + 1).drop("_n").withColumn("gtid", F.concat(F.lit(SERVER), F.substring("db_id", 4, 1), F.lit(":"), F.col("seq").cast("string"))).withColumn("op", op)


STREAM = f"""
stream as (
  select event_id, ts, user_id, event_type, cast(cast(value as decimal(18,2)) as varchar) as value_text, 'db-' || (user_id % 4) as db_id,
    row_number() over (partition by user_id % 4 order by event_id) as seq,
    '{SERVER}' || (user_id % 4) || ':' || row_number() over (partition by user_id % 4 order by event_id) as gtid,
    case event_type when 'signup' then 'INSERT' when 'click' then 'UPDATE' when 'purchase' then 'UPDATE' when 'error' then 'DELETE' else 'READ' end as op
  from events)"""


def sealed(spark: SparkSession, root: str) -> DataFrame:
    """The stream as canonical records with id and hash, shaped for segments."""
    return shaped(stream(spark, root))


def shaped(s: DataFrame, *kept: str) -> DataFrame:
    """``sealed`` of a stream that is there already, with the columns in kept."""
    core = C.obj({"db_id": C.token(F.col("db_id")), "event_id": F.col("event_id").cast("string"), "event_type": C.token(F.col("event_type")), "gtid": C.token(F.col("gtid")), "ts": C.token(C.iso_ms(F.col("ts"))), "user_id": F.col("user_id").cast("string"), "value": C.token(F.col("value_text"))})
    return s.select(
        "db_id", F.col("event_id").alias("arrival"), F.unix_millis("ts").alias("at_ms"), C.envelope_id(F.col("db_id"), F.col("gtid"), F.lit(SERVER)).alias("envelope_id"), core.alias("core"), C.sha(core).alias("event_hash"),
        C.iso_ms(F.col("ts")).alias("commit_iso"), "gtid", F.lit(None).cast("string").alias("binlog_file"), F.lit(None).cast("bigint").alias("binlog_pos"), F.lit(None).cast("string").alias("epoch_id"),
        F.lit("events").alias("schema_name"), F.col("event_type").alias("object_name"), F.sha2(F.col("event_id").cast("string"), 256).alias("key_hash"),
        F.when(F.col("event_type") == "error", "DEGRADED").otherwise("HEALTHY").alias("state"), F.when(F.col("event_type") == "error", "error event").alias("reason"), (F.col("seq") % 97 == 0).alias("gap_detected"), F.col("gtid").alias("offset_key"), *kept,
    )


SEALED = STREAM + f""",
sealed as (
  select db_id, event_id as arrival, epoch_us(ts) // 1000 as at_ms, gtid, seq, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as commit_iso,
    '{{"db_id":"' || db_id || '","event_id":' || event_id || ',"event_type":"' || event_type || '","gtid":"' || gtid || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","user_id":' || user_id || ',"value":"' || value_text || '"}}' as core,
    sha1(unhex('{C.ENVELOPE_NAMESPACE.replace("-", "")}') || encode(db_id || '|' || gtid || '|{SERVER}')) as d
  from stream),
hashed as (
  select *, 'sha256:' || sha256(core) as event_hash,
    d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', d[17]) - 1) % 4, 1) || d[18:20] || '-' || d[21:32] as envelope_id
  from sealed)"""
