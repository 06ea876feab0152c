"""A stream taken in micro-batches gives what one batch gives."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeline.functions import canonical as C
from lodeline.operators import segments
from lodeline.streaming import audit

T0 = datetime(2026, 1, 1)


def drain(stream, tmp_path, name, mode="append", sink=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("memory").queryName(name).start()
    query.awaitTermination(120)
    return None if sink else stream.sparkSession.table(name)


def folder(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_deduplicated(spark, tmp_path):
    path = folder(spark, tmp_path, [[("a", 1), ("b", 1)], [("a", 2), ("c", 2)], [("c", 3)]], "id string, n int")
    got = drain(audit.deduplicated(audit.table_stream(spark, path), ["id"]), tmp_path, "dedup")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c"]


def test_segments_equal_batch(spark, tmp_path):
    rows = [("d", i, i * 40) for i in range(12)] + [("e", i, i * 10) for i in range(5)]
    schema = "db_id string, arrival bigint, at_ms bigint"
    path = folder(spark, tmp_path, [[r for r in rows if r[1] < 4], [r for r in rows if 4 <= r[1] < 8], [r for r in rows if r[1] >= 8]], schema)
    got = drain(audit.segmented(audit.table_stream(spark, path, 10), 3, 100_000), tmp_path, "seg")
    want = segments.assigned(spark.createDataFrame(rows, schema), 3, 100_000).select("db_id", "arrival", "segment_sequence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tumbling_and_late_rows(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    path = folder(spark, tmp_path, [[("k", at(1)), ("k", at(2))], [("k", at(200))], [("k", at(400))]], "key string, ts timestamp")
    got = drain(audit.tumbling_counts(audit.table_stream(spark, path), ["key"], "ts", "60 seconds", "10 seconds"), tmp_path, "tumble")
    assert {(r["window_start"], r["n"]) for r in got.collect()} >= {(T0, 2)}
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    r = audit.rerouted(spark.createDataFrame([(at(1),), (at(130),)], "ts timestamp"), "ts", 60_000, base + 120_000).orderBy("ts").collect()
    assert [(x["late"], x["window_ms"] - base) for x in r] == [(True, 120_000), (False, 120_000)]


def test_upsert_sink(spark, tmp_path):
    path = folder(spark, tmp_path, [[("a", 1), ("b", 1)], [("a", 3)], [("a", 2), ("c", 1)]], "id string, n int")
    drain(audit.table_stream(spark, path), tmp_path, "upsert", sink=audit.upsert_sink(str(tmp_path / "out"), ["id"], "n"))
    last = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / last)).select("id", F.col("n")).collect())) == [("a", 3), ("b", 1), ("c", 1)]


def test_guard_chain_and_consumed_set_keep_state(spark, tmp_path):
    rows = [("e1", 1, "h1", "d"), ("e2", 2, "h2", "d"), ("e1", 3, "h1", "d"), ("e1", 4, "x", "d"), ("e3", 5, "h3", "f"), ("e2", 6, "h2", "d")]
    schema = "envelope_id string, arrival bigint, event_hash string, db_id string"
    path = folder(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], schema)
    got = {r["arrival"]: r["outcome"] for r in drain(audit.guarded(audit.table_stream(spark, path)), tmp_path, "guard").collect()}
    assert got == {1: "EMIT", 2: "EMIT", 3: "DUPLICATE", 4: "INTEGRITY_VIOLATION", 5: "EMIT", 6: "DUPLICATE"}
    links = {r["arrival"]: (r["prev_row_hash"], r["row_hash"]) for r in drain(audit.chained(audit.table_stream(spark, path)), tmp_path, "chain").collect()}
    before = {}
    for _, n, h, db in rows:
        previous = before.get(db, C.GENESIS)
        before[db] = "sha256:" + hashlib.sha256((previous + h).encode()).hexdigest()
        assert links[n] == (previous, before[db])


def test_consumed_set(spark, tmp_path):
    path = folder(spark, tmp_path, [[("d", "k", 1, 3), ("d", "k", 7, 7)], [("d", "k", 4, 5)], [("d", "k", 6, 6), ("d", "j", 9, 2)]], "db_id string, key string, start bigint, end bigint")
    got = drain(audit.consumed(audit.table_stream(spark, path)), tmp_path, "consumed", mode="update").collect()
    assert [(r["runs"], r["high_watermark"], r["gap_detected"]) for r in got] == [("1-3:7", 7, True), ("1-5:7", 7, True), ("1-7", 7, False)]


def test_append_sink_replaces_a_replayed_batch(spark, tmp_path):
    sink = audit.append_sink(str(tmp_path / "out"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    for _ in range(2):
        sink(df, 0)
    sink(df.where("n = 1"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 2), (1, 1)]
