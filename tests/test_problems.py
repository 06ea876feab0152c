"""Problems 1 to 5 against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeline.operators import changelog, delivery, drift, history, nested

T0 = datetime(2017, 3, 1)
CHANGE = (
    "change_id bigint, db_id string, engine string, schema_name string, object_name string, primary_key string, operation string, before_image string, after_image string, ddl_statement string, ddl_effect string,"
    " gtid string, binlog_file string, binlog_pos bigint, row_no int, snapshot_phase string, commit_ts timestamp, ingest_ts timestamp"
)
MONITORED = [("users", "id", "email"), ("user_roles", "user_id,role_id", None), ("wallets", "id", None)]


def monitored(spark):
    return spark.createDataFrame(MONITORED, "object_name string, pk_columns string, sensitive_columns string")


def change(n, op, obj, before, after, file="mysql-bin.000001", pos=1, row=0, db="a", at=None):
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return (n, db, "mysql", "s", obj, None, op, text(before), text(after), None, None, None, file, pos, row, "streaming", T0 + timedelta(seconds=n) if at is None else at, T0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 1

def brute_cases(text):
    """Straight from the statement: all objects that are elements of lists."""
    def load(x):
        return json.loads(x, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))

    try:
        doc = load(text)
        while isinstance(doc, str):
            doc = load(doc)
        if isinstance(doc, dict) and "schema" in doc and "payload" in doc:
            doc = doc["payload"]
            while isinstance(doc, str):
                doc = load(doc)
    except (ValueError, TypeError):
        return []
    out = []

    def go(x, path, parent, listed):
        if listed and isinstance(x, str):
            try:
                y = load(x)
                x = y if isinstance(y, (list, dict)) else x
            except ValueError:
                pass
        if listed and isinstance(x, dict):
            x = [x]
        if isinstance(x, list):
            for i, y in enumerate(x):
                here = f"{path}[{i}]"
                if isinstance(y, dict):
                    out.append((here, parent))
                go(y, here, here if isinstance(y, dict) else parent, False)
        elif isinstance(x, dict):
            for k, y in x.items():
                go(y, f"{path}.{k}" if path else k, parent, k in nested.LIST_MEMBERS)

    go(doc, "", "", False)
    return out


def test_nested_edges(spark):
    texts = [
        None, "", "  ", "nonsense", "{'a': 1}", '{"a": NaN}', "3", "null", "[]", '[{"x": 1}, 2, [{"y": 2}]]', '"[{\\"x\\":1}]"', '{"schema": null, "payload": "{\\"steps\\":{\\"no\\":1}}"}',
        '{"schema": 1, "payload": null}', '{"allocations": "[{\\"approvals\\": {\\"by\\": 1}}]"}', '{"allocations": "no list", "other": "[{}]"}', '{"tags": [1, {"a": {"history": [null, {"b": [{}]}]}}]}',
        '{"entries": []}', '{"entries": null}', '{"a.b": [{"c": 1}]}', '{"x": {"x": {"x": [{"x": [{}]}]}}}',
    ]
    raw = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "delivery_id bigint, value_json string, source_table string")
    dlq = spark.createDataFrame([], "delivery_id bigint, original_payload string")
    got = sorted((r["delivery_id"], r["node_path"], r["parent_path"]) for r in nested.p1_found(raw, dlq).collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in brute_cases(t))


def test_nested_whole_table(spark):
    root = Path("/root/testdata/sf0.001")
    if not root.exists():
        pytest.skip("no test data")
    raw, dlq = spark.read.parquet(f"{root}/raw_source_event.parquet"), spark.read.parquet(f"{root}/dlq.parquet")
    want = [("raw_source_event", r[0], *c) for r in raw.select("delivery_id", "value_json").collect() for c in brute_cases(r[1])]
    want += [("dlq", r[0], *c) for r in dlq.select("delivery_id", "original_payload").collect() for c in brute_cases(r[1])]
    assert rows(nested.p1_found(raw, dlq)) == sorted(want, key=repr)


def shredded(spark, docs):
    df = spark.createDataFrame([("raw", i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "source_table string, delivery_id bigint, text string")
    return df, nested.tabled_types(nested.schema_graph(df))


def test_nested_tables_hold_every_value(spark):
    docs, tabled = shredded(spark, [{"id": 1, "price": 159.160, "who": {"name": "n", "at": {"x": [1, 2]}}, "steps": [{"no": 1, "who": {"name": "m"}}, None, "t"]}])
    assert {r["type"] for r in tabled.collect()} == {"steps", "who", "x"}  # repeated, shared; at is inlined
    found = nested.flat_rows(docs, tabled).collect()
    path = {r["node"]: r["node_path"] for r in found}
    got = {(r["table"], r["node_path"]): (path.get(r["parent_node"]), dict(r["attributes"])) for r in found}
    assert got["$", ""] == (None, {"id": "1", "price": "159.16"})
    assert got["who", "who"] == ("", {"name": "n"})
    assert got["x", "who.at.x[1]"] == ("who", {"value": "2"})
    assert got["steps", "steps[0]"] == ("", {"no": "1"})
    assert got["who", "steps[0].who"] == ("steps[0]", {"name": "m"})
    assert got["steps", "steps[1]"] == ("", {}) and got["steps", "steps[2]"] == ("", {"value": "t"})
    assert sorted(r["name"] for r in nested.tables(docs, tabled, {"who": ["name"]})["who"].collect()) == ["m", "n"]


def test_nested_rows_come_from_the_plan_and_the_keys(spark):
    docs, tabled = shredded(spark, [{"steps": [{"who": {"notes": [{"a": 1}]}}], "who": {"notes": []}}])
    cases = lambda t: {(r["node_path"], r["parent_path"]) for r in nested.flat_rows(docs, t, attributes=False).where("is_element and is_object").collect()}
    whole = {("steps[0]", ""), ("steps[0].who.notes[0]", "steps[0]")}
    assert cases(tabled) == whole
    # a repeated type that the graph doesn't table has no rows; its values stay with the parent
    wrong = tabled.where("type <> 'notes'")
    assert cases(wrong) == {("steps[0]", "")}
    assert any("notes" in r["attributes"] for r in nested.flat_rows(docs, wrong).collect())
    # a wrong foreign key gives a wrong parent
    rows_ = list(nested.shred({"a": [{"b": [{}]}, {}]}, nested.Plan(frozenset("ab")), False))
    assert [r[-1] for r in nested.followed(rows_)] == ["", "", "a[0]", ""]
    rows_[2] = (*rows_[2][:4], 0, *rows_[2][5:])
    assert [r[-1] for r in nested.followed(rows_)][2] == ""


def test_many_types_are_joined(spark):
    """Beyond max_plan documents are joined to their own types; the rows are the same."""
    docs, tabled = shredded(spark, [{f"list{i}": [{"v": i, "who": {"n": i}}], "who": {"n": 1}, "t": {"steps": "[{}, {\"changes\": {}}]"}} for i in range(60)] + ["bad", "3"])
    key = lambda r: (r["delivery_id"], r["node"])
    a, b = (sorted(nested.flat_rows(docs, tabled, max_plan=m).collect(), key=key) for m in (1000, 5))
    assert a == b and len(a) > 240


def test_deep_and_long_documents_are_read(spark):
    depth = 20_000
    deep = '{"a":' * depth + '[{"n": 1}]' + "}" * depth
    long = '{"id": ' + "7" * 6_000 + ', "steps": [{"no": 1e400, "x": 0.10}]}'
    docs, tabled = shredded(spark, [deep, long, "[" * depth + "]" * depth, "[" * depth + "]" * (depth - 1), '{"a":' * depth + "}" * depth])
    got = {r["delivery_id"]: r for r in nested.flat_rows(docs, tabled).where("is_element and is_object").collect()}
    assert got[0]["node_path"] == ".".join(["a"] * depth) + "[0]" and got[1]["attributes"] == {"no": "1E+400", "x": "0.10"}
    assert {(r["delivery_id"], r["reason"]) for r in nested.refused(docs).collect()} == {(3, "invalid"), (4, "invalid")}
    root = nested.flat_rows(docs, tabled).where("delivery_id = 1 and parent_node is null").first()
    assert root["attributes"]["id"] == "7" * 6_000


def test_the_deep_parser_is_the_parser():
    rng = random.Random(9)

    def value(depth):
        kind = rng.choice("dlsnbx0f") if depth else rng.choice("snbx0f")
        if kind == "d":
            return {rng.choice(["a", "b", 'q"', "", "\u00e9"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if kind == "l":
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {"s": 'x\n"\\', "n": None, "b": True, "x": "", "0": -12, "f": 1.5}[kind]

    for _ in range(400):
        text = json.dumps(value(5), indent=rng.choice([None, 1]))
        if rng.random() < 0.5 and text:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(['', '"', "]", "}", ",", ":", " ", "1", "-"]) + text[i + 1:]
        out = []
        for f in (nested._DECODER.decode, nested._load_deep):
            try:
                out.append(repr(f(text)))
            except ValueError:
                out.append("invalid")
        assert out[0] == out[1], text


# ---- 2

def test_drift(spark):
    u = "users"
    data = [
        change(1, "INSERT", u, None, {"id": 1, "name": "n", "email": "e1", "gone": 1, "flag": None}, "mysql-bin.999999"),
        change(2, "INSERT", "`s`.`Users`", None, {"id": 2, "name": "m", "email": "e2", "gone": 2}, "mysql-bin.999999", 2),
        change(3, "UPDATE", "USERS", {"id": 1}, {"id": 1, "name": {"first": "n"}, "mail": "e1", "fresh": [1]}, "mysql-bin.1000000"),
        change(4, "UPDATE", u, {"id": 1}, {"id": 1, "name": {"first": "n"}, "Mail": "e1", "fresh": [1]}, "mysql-bin.1000002"),
        change(5, "UPDATE", u, {"id": 1}, "not json", "mysql-bin.1000002", 3),
        change(6, "DELETE", u, {"id": 1}, None, "mysql-bin.1000003"),
        change(7, "INSERT", "wallets", None, {"id": 1}, "mysql-bin.000001"),
    ]
    got = rows(drift.p2_found(spark.createDataFrame(data, CHANGE), monitored(spark)))
    assert got == sorted([
        ("a", "users", "mysql-bin.1000000", "renamed", "mail", "email"), ("a", "users", "mysql-bin.1000000", "removed", "gone", ""), ("a", "users", "mysql-bin.1000000", "removed", "flag", ""),
        ("a", "users", "mysql-bin.1000000", "added", "fresh", ""), ("a", "users", "mysql-bin.1000000", "retyped", "name", ""), ("a", "users", "mysql-bin.1000002", "renamed", "Mail", "mail"),
    ], key=repr)
    one = {r["change_id"]: dict(r["fields"]) for r in drift.unified(spark.createDataFrame(data, CHANGE), monitored(spark)).collect() if r["fields"]}
    assert one[1]["Mail"] == "e1" and one[3]["Mail"] == "e1" and "email" not in one[1]


def test_rename_seen_only_far_from_the_transition(spark):
    """No row is written both in the file before and in the file of the rename; rows written earlier and later keep their values."""
    u, file = "users", lambda n: f"mysql-bin.{n:06}"
    data = [
        change(1, "INSERT", u, None, {"id": 1, "created_at": 10, "email": "x"}, file(1)),
        change(2, "INSERT", u, None, {"id": 2, "created_at": 20}, file(2)),  # email is null and left out
        change(3, "INSERT", u, None, {"id": 3, "created_at": 30, "email": "z"}, file(3)),
        change(4, "INSERT", u, None, {"id": 4, "created_on": 40, "mail": "m"}, file(4)),
        change(5, "INSERT", u, None, {"id": 5, "created_on": 50}, file(5)),
        change(6, "UPDATE", u, {"id": 1}, {"id": 1, "created_on": 10.0, "mail": "x"}, file(6)),
    ]
    got = rows(drift.p2_found(spark.createDataFrame(data, CHANGE), monitored(spark)))
    assert ("a", u, file(4), "renamed", "created_on", "created_at") in got
    assert ("a", u, file(4), "renamed", "mail", "email") in got
    assert not [r for r in got if r[2] == file(4) and r[3] != "renamed"]


def test_rename_needs_its_own_spells(spark):
    """The old name's values count only since the new name was last seen, the new name's only until the old one returns."""
    u, file = "users", lambda n: f"mysql-bin.{n:06}"
    data = [
        change(1, "INSERT", u, None, {"id": 1, "a": 7}, file(1)), change(2, "INSERT", u, None, {"id": 2, "b": 8}, file(2)), change(3, "INSERT", u, None, {"id": 3, "a": 9}, file(3)),
        change(4, "INSERT", u, None, {"id": 4, "b": 5}, file(4)), change(5, "UPDATE", u, {"id": 1}, {"id": 1, "b": 7}, file(5)),
    ]
    got = rows(drift.p2_found(spark.createDataFrame(data, CHANGE), monitored(spark)))
    assert {r[3] for r in got} == {"added", "removed"} and len(got) == 6


def test_full_sketches_lose_no_rename(spark):
    """One row among many keeps its value: too rare for a sketch that samples, but it is a rename."""
    n = drift.EXACT * 3
    before = spark.range(n).selectExpr("id", "'mysql-bin.000001' as binlog_file", "to_json(struct(id as id, id as old)) as after_image")
    after = spark.range(n).selectExpr("id + 1000000 as id", "'mysql-bin.000002' as binlog_file", "to_json(struct(if(id = 77, 77, id + 50000) as id, if(id = 77, 77, id + 50000) as fresh)) as after_image")
    data = before.unionByName(after).selectExpr("id as change_id", "'a' as db_id", "'users' as object_name", "binlog_file", "after_image")
    assert rows(drift.p2_found(data, monitored(spark))) == [("a", "users", "mysql-bin.000002", "renamed", "fresh", "old")]


def test_drift_of_nothing(spark):
    assert rows(drift.p2_found(spark.createDataFrame([], CHANGE), monitored(spark))) == []


def test_assignment_is_best():
    rng = random.Random(2)
    from itertools import permutations

    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = [[rng.choice([0, 0, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in drift.assignment(w))
        k = max(n, m)
        best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in permutations(range(k)))
        assert abs(got - best) < 1e-9


# ---- 3

def brute_state(data):
    once = {}
    for c in sorted(data):
        once.setdefault((c[1], int(c[12].rsplit(".", 1)[1]), c[13], c[14]), c)
    keys = {o: k.split(",") for o, k, _ in MONITORED}
    live = {}
    for at in sorted(once):
        c = once[at]
        obj = c[4].lower().replace("`", "").split(".")[-1]

        def key(text, obj=obj):
            image = json.loads(text) if text else None
            values = [image.get(k) for k in keys[obj]] if image else [None]
            return None if any(v is None for v in values) else "|".join(map(str, values))

        if c[6] == "TRUNCATE":
            live = {k: v for k, v in live.items() if k[:2] != (c[1], obj)}
        if c[6] in ("UPDATE", "DELETE") and key(c[7]):
            live.pop((c[1], obj, key(c[7])), None)
        if c[6] in ("INSERT", "UPDATE") and key(c[8]):
            live[c[1], obj, key(c[8])] = (c[12], c[13], c[14])
    return sorted(((*k, *v) for k, v in live.items()), key=repr)


def random_changes(rng, n):
    out = []
    for i in range(n):
        obj = rng.choice(["users", "`s`.`Users`", "user_roles", "WALLETS"])
        image = lambda o=obj: {"id": rng.randint(1, 4), "user_id": rng.randint(1, 2), "role_id": rng.choice([1, 2, None]), "status": rng.choice(["a", " A ", "b"])}
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE", "TRUNCATE", "DDL"])
        before = image() if op in ("UPDATE", "DELETE") else None
        after = image() if op in ("INSERT", "UPDATE") else None
        if op == "UPDATE" and rng.random() < 0.7:
            after = {**after, **{k: before[k] for k in ("id", "user_id", "role_id")}}
        out.append(change(i, op, obj, before, after, f"mysql-bin.{rng.choice([999998, 999999, 1000000, 1000001])}", rng.randint(1, 30), rng.randint(0, 1), rng.choice("ab")))
    # repeats of a change are equal but for their delivery
    out += [(n + i, *c[1:]) for i, c in enumerate(rng.sample(out, n // 5))]
    # one change for each position
    first = {}
    for c in out:
        first.setdefault((c[1], c[12], c[13], c[14]), c)
    out = [(c[0], *first[c[1], c[12], c[13], c[14]][1:]) for c in out]
    rng.shuffle(out)
    return out


def test_changelog(spark):
    data = random_changes(random.Random(4), 300)
    df = spark.createDataFrame(data, CHANGE).withColumn("row_key", F.lit("clash")).withColumn("step", F.lit(9))
    assert rows(changelog.p3_found(df, monitored(spark))) == brute_state(data)
    held = changelog.state(df, monitored(spark)).collect()
    assert all(r["multiplicity"] == 1 for r in held) and {r["base"] for r in held} <= {0, 1}
    assert rows(changelog.current_rows(df, monitored(spark)).drop("image")) == brute_state(data)
    assert rows(changelog.p3_found(df.limit(0), monitored(spark))) == []


def test_multiplicities_are_clamped_sums(spark, monkeypatch):
    """The fold by blocks equals the running sum, however the blocks are cut; without the sum no row is found."""
    rng = random.Random(11)
    signs = [rng.choice([1, -1]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(signs)), "n int, sign int")
    for size in (1, 7, 60):
        part = df.groupBy(F.floor(F.col("n") / size).alias("b")).agg(changelog._folded(F.collect_list(F.struct("n", changelog._add(F.col("sign")).alias("f")))).alias("f"))
        f = part.agg(changelog._folded(F.collect_list(F.struct("b", "f"))).alias("f")).first()["f"]
        for base in (0, 1):
            x = base
            for s in signs:
                x = min(1, max(0, x + s))
            assert min(f["high"], max(f["low"], base + f["sum"])) == x
    fed = [change(1, "UPDATE", "users", {"id": 2}, {"id": 2}), change(2, "UPDATE", "users", {"id": 2}, {"id": 3}, pos=2), change(3, "INSERT", "users", None, {"id": 3}, pos=3)]
    assert [(r["row_key"], r["base"], r["total"], r["multiplicity"]) for r in changelog.state(spark.createDataFrame(fed, CHANGE), monitored(spark)).collect()] == [("3", 0, 2, 1)]
    assert [(r["row_key"], r["base"], r["total"]) for r in changelog.state(spark.createDataFrame(fed[:1], CHANGE), monitored(spark)).collect()] == [("2", 1, 0)]
    data = spark.createDataFrame([change(1, "INSERT", "users", None, {"id": 1})], CHANGE)
    assert changelog.p3_found(data, monitored(spark)).count() == 1
    monkeypatch.setattr(changelog, "_add", lambda sign: F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    assert changelog.p3_found(data, monitored(spark)).count() == 0


# ---- 4

def test_deliveries(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    raw = spark.createDataFrame([
        (1, "t", "5-0", at(3)), (2, "t", " 5", at(1)), (3, "t", "05-00\n", at(1)), (4, "u", "5-0", at(0)), (5, "t", None, at(0)), (6, "t", None, at(0)), (7, "t", "5-1", at(9)), (8, None, "5", at(1)), (9, None, "5-0", None), (10, "t", "odd", at(1)), (11, "t", "odd ", at(2)), (12, "t", " ", at(1)), (13, "t", "", at(1)),
    ], "delivery_id bigint, topic string, stream_id string, received_at timestamp")
    h = "ab" * 32
    derived = "dlq-" + __import__("hashlib").sha256(f"mysql||sha256:{h}".encode()).hexdigest()[:32]
    x = "0123456789abcdef" * 2
    dlq = spark.createDataFrame([
        (1, f"dlq-{x}", "mysql", "o", None, at(1)), (2, f" DLQ-{x.upper()}", "mysql", "o", None, at(2)), (3, x, "mysql", "o", None, at(2)), (4, None, "mysql", None, h.upper(), at(1)), (5, derived, "mysql", "z", None, None), (6, None, "mysql", None, None, at(1)), (7, " ", "mysql", None, None, at(1)), (8, "dlq- ", "mysql", None, h, at(0)),
    ], "delivery_id bigint, event_id string, source_engine string, offset_key string, payload_hash string, last_seen timestamp")
    assert rows(delivery.p4_found(raw, dlq)) == sorted([("raw_source_event", 1), ("raw_source_event", 3), ("raw_source_event", 9), ("raw_source_event", 11), ("dlq", 1), ("dlq", 2), ("dlq", 5), ("dlq", 8)], key=repr)
    assert sorted(r["delivery_id"] for r in delivery.once_raw(raw).collect()) == [2, 4, 5, 6, 7, 8, 10, 12, 13]
    assert delivery.once_dlq(dlq).count() == 4
    assert rows(delivery.p4_found(raw.limit(0), dlq.limit(0))) == []


# ---- 5

def test_history(spark):
    u = "users"
    data = [
        change(1, "INSERT", u, None, {"id": 1, "status": "a"}, pos=1), change(2, "UPDATE", u, {"id": 1, "status": "a"}, {"id": 1, "status": " A\t"}, pos=2), change(3, "UPDATE", u, {"id": 1, "status": "a"}, {"id": 1, "status": "b"}, pos=3),
        change(4, "DELETE", u, {"id": 1, "status": "b"}, None, pos=4), change(5, "INSERT", u, None, {"id": 1, "status": "b"}, pos=5), change(15, "INSERT", u, None, {"id": 1, "status": "b"}, pos=5),
        change(6, "UPDATE", u, {"id": 2, "status": "x"}, {"id": 2, "status": "x"}, pos=6), change(7, "DELETE", u, {"id": 2, "status": "x"}, None, "mysql-bin.000002", 1), change(8, "DELETE", u, {"id": 3, "status": "y"}, None, pos=8),
        change(9, "UPDATE", u, {"id": 4, "status": "p"}, {"id": 5, "status": "q"}, pos=9), change(10, "INSERT", "wallets", None, {"id": 1, "status": "a"}, pos=10),
    ]
    ms = lambda n: int((T0 + timedelta(seconds=n) - datetime(1970, 1, 1)).total_seconds() * 1000)
    snaps = [
        (T0, "a", 1, "a", T0), (T0, "a", 1, "c", T0 + timedelta(1)), (T0 + timedelta(40), "a", 1, None, T0), (T0 + timedelta(80), "a", 1, "C ", T0), (T0 + timedelta(90), "a", 1, "d", T0), (None, "a", 1, "z", T0), (T0, None, 1, "z", T0), (T0, "a", None, "z", T0), (T0, "a", 2, "e", None),
    ]
    users = spark.createDataFrame(snaps, "snapshot_ts timestamp, db_id string, id bigint, status string, loaded_at timestamp")
    day = lambda n: ms(n * 86400)
    got = rows(history.p5_found(spark.createDataFrame(data, CHANGE), monitored(spark), users))
    assert got == sorted([
        ("changes", "a", u, "1", ms(1), ms(3)), ("changes", "a", u, "1", ms(3), ms(4)), ("changes", "a", u, "1", ms(5), -1), ("changes", "a", u, "2", -1, ms(7)), ("changes", "a", u, "3", -1, ms(8)),
        ("changes", "a", u, "4", -1, ms(9)), ("changes", "a", u, "5", ms(9), -1),
        ("snapshots", "a", u, "1", ms(0), day(90)), ("snapshots", "a", u, "1", day(90), -1), ("snapshots", "a", u, "2", ms(0), -1),
    ], key=repr)


def points(spark, data):
    df = spark.createDataFrame([("s", "a", "u", e, a, at, at, on, v) for e, a, at, on, v in data], "origin string, db_id string, object_name string, entity_id string, attribute string, at int, ts bigint, opens boolean, value string")
    return df.withColumn("block", F.floor(F.col("at") / 8)).withColumn("at", F.struct("at"))


def test_combined_history(spark):
    log = points(spark, [("1", "x", 0, True, "1"), ("1", "x", 10, True, "2"), ("1", "y", 5, True, "p"), ("1", "y", 10, True, "p"), ("1", "y", 20, False, None), ("2", "y", 1, True, None), ("2", "y", 3, False, None)])
    got = rows(history.combined(log, ["x", "y"]).select("entity_id", "x", "y", "valid_from_ms", "valid_to_ms"))
    assert got == [("1", "1", "p", 5, 10), ("1", "1", None, 0, 5), ("1", "2", "p", 10, 20), ("1", "2", None, 20, -1), ("2", None, None, 1, 3)]
    assert rows(history.attribute_log(log).select("entity_id", "attribute", "value", "valid_from_ms", "valid_to_ms")) == [
        ("1", "x", "1", 0, 10), ("1", "x", "2", 10, -1), ("1", "y", "p", 10, 20), ("1", "y", "p", 5, 10), ("2", "y", None, 1, 3)]
    # with one attribute, equal neighbours are one version too
    assert rows(history.combined(log, ["y"]).where("entity_id = '1'").select("y", "valid_from_ms", "valid_to_ms")) == [("p", 5, 20)]


def test_found_versions_are_the_combined_ones(spark, monkeypatch):
    """p5_found takes its rows from the coalescing: without it there are none."""
    data = spark.createDataFrame([change(1, "INSERT", "users", None, {"id": 1, "status": "a"})], CHANGE)
    users = spark.createDataFrame([], "snapshot_ts timestamp, db_id string, id bigint, status string, loaded_at timestamp")
    assert history.p5_found(data, monitored(spark), users).count() == 1
    whole = history.combined
    monkeypatch.setattr(history, "combined", lambda p, a: whole(p.limit(0), a))
    assert history.p5_found(data, monitored(spark), users).count() == 0


def test_times_out_of_order_move_no_boundary(spark):
    """Null, equal and falling commit times: versions follow the log."""
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    data = [(*change(i, "UPDATE", "users", {"id": 1, "status": "o"} if i == 1 else {"id": 1}, {"id": 1, "status": v}, pos=i)[:16], at(t), T0) for i, (v, t) in enumerate([("a", 9), ("b", None), ("c", 5), ("d", 5), ("d", 1), ("a", 2)], 1)]
    users = spark.createDataFrame([], "snapshot_ts timestamp, db_id string, id bigint, status string, loaded_at timestamp")
    got = sorted(((r["valid_from_ms"], r["valid_to_ms"]) for r in history.p5_found(spark.createDataFrame(data, CHANGE), monitored(spark), users).collect()), key=repr)
    ms = lambda s: int((T0 + timedelta(seconds=s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got == sorted([(-1, ms(9)), (ms(9), None), (None, ms(5)), (ms(5), ms(5)), (ms(5), ms(2)), (ms(2), -1)], key=repr)
