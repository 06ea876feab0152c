"""Declarative detection rules, compiled to Column expressions.

A rule is a dict: id, base, modifiers, when (a tree of all / any / not over
leaves). A leaf is {leaf: name, ...}. Every leaf is computed for every event; a
leaf that can't be decided is null, and one null makes the rule INDETERMINATE
whatever the others say. Rules about a business's amounts, states and privileges
aren't built in: they are compositions of these leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.ordered import carry, fold

MAX_DEPTH, MAX_LEAVES = 8, 64
BANDS = ((80, "critical"), (50, "high"), (25, "medium"), (0, "low"))

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "in": lambda a, b: a.isin(*b), "not_in": lambda a, b: ~a.isin(*b), "matches": lambda a, b: a.rlike(b), "exists": lambda a, b: a.isNotNull() == b, "is_null": lambda a, b: a.isNull() == b,
}


def compare(value: Column, op: str, other: object) -> Column:
    """A comparison with a two-valued answer: an absent value satisfies nothing but is_null and exists. Numbers compare as exact decimals."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if isinstance(other, (int, float)) and not isinstance(other, bool):
        value = value.try_cast("decimal(38,10)")
    return F.coalesce(OPERATORS[op](value, other), F.lit(False))


def bare_token(token: Column) -> Column:
    """Text of a JSON token: strings without quotes, null for null."""
    return F.when(token != "null", F.when(token.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")).otherwise(token))


def _field_change(leaf: dict) -> Column:
    def one(f: Column) -> Column:
        ok = f["path"] == leaf["field"]
        for name, side in (("to", "new"), ("from", "old")):
            if name in leaf:
                ok = ok & F.coalesce(bare_token(f[side]) == leaf[name], F.lit(False))
        for side in ("old", "new"):
            for op, other in leaf.get(side, {}).items():
                ok = ok & compare(bare_token(f[side]), op, other)
        return ok

    return F.exists("fields", one)


def _value(leaf: dict) -> Column:
    return compare(F.get_json_object(leaf.get("image", "after_image"), "$." + leaf["field"]), leaf["op"], leaf.get("value"))


def _operation(leaf: dict) -> Column:
    return F.col("operation").isin(*leaf["one_of"])


def _object(leaf: dict) -> Column:
    return F.col("object").isin(*leaf["one_of"])


def _outside_hours(leaf: dict) -> Column:
    local = F.from_utc_timestamp(F.col(leaf.get("ts", "ts")).cast("timestamp"), leaf.get("tz", "UTC"))
    minute = F.hour(local) * 60 + F.minute(local)
    first, last = (int(h) * 60 + int(m) for h, m in (leaf[k].split(":") for k in ("from", "to")))
    return ~(((F.dayofweek(local) + 5) % 7 + 1).isin(*leaf["days"]) & (minute >= first) & (minute < last))


def _flag(leaf: dict) -> Column:
    """A looked-up flag; null where the lookup wasn't available."""
    return F.col(leaf["column"])


def _transaction(leaf: dict) -> Column:
    """statement_count, distinct_tables_count, contains_operation, all_operations_are or touches_table of a transaction (columns operations and tables, arrays with one entry for each change)."""
    kind = leaf["predicate"]
    if kind == "statement_count":
        return compare(F.size("operations").cast("string"), leaf["op"], leaf["value"])
    if kind == "distinct_tables_count":
        return compare(F.size(F.array_distinct("tables")).cast("string"), leaf["op"], leaf["value"])
    if kind == "contains_operation":
        return F.array_contains("operations", leaf["value"])
    if kind == "all_operations_are":
        return (F.size("operations") > 0) & F.forall("operations", lambda o: o == leaf["value"])
    if kind == "touches_table":
        return F.array_contains("tables", leaf["value"])
    raise ValueError(f"unknown predicate {kind!r}")


#: Ranks of attribution, the weakest first.
CONFIDENCES = ("unattributed", "probable", "exact")


def _behaviour(leaf: dict) -> Column:
    """outside_business_hours, unusual_host, new_actor (columns of ``known_actors``), actor_in_list, actor_not_in_list, privilege_role_in or confidence_below."""
    kind = leaf["predicate"]
    if kind == "outside_business_hours":
        return _outside_hours(leaf)
    if kind in ("unusual_host", "new_actor"):
        return F.col(kind)
    listed = {"actor_in_list": "actor", "actor_not_in_list": "actor", "privilege_role_in": "actor_role"}
    if kind in listed:
        found = F.coalesce(F.col(listed[kind]).isin(*leaf["values"]), F.lit(False))
        return ~found & F.col("actor").isNotNull() if kind == "actor_not_in_list" else found
    if kind == "confidence_below":
        return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCES]), F.coalesce("attribution_confidence", F.lit(CONFIDENCES[0]))) < CONFIDENCES.index(leaf["value"]) + 1
    raise ValueError(f"unknown predicate {kind!r}")


def _fidelity(leaf: dict) -> Column:
    """What is wrong with the capture itself: state_not_healthy, gap_detected, row_image_downgraded, audit_plugin_disabled or attribution_unavailable_on_sensitive. Null where it isn't known."""
    kind = leaf["predicate"]
    of = {
        "state_not_healthy": lambda: F.col("fidelity_state").isin("DEGRADED", "COMPROMISED"), "gap_detected": lambda: F.col("gap_detected"), "row_image_downgraded": lambda: F.upper("binlog_row_image") != "FULL",
        "audit_plugin_disabled": lambda: F.array_contains("tamper_indicators", "AUDIT_PLUGIN_DISABLED"),
        "attribution_unavailable_on_sensitive": lambda: F.col("sensitive") & (F.col("attribution_confidence") == "unattributed"),
    }
    if kind not in of:
        raise ValueError(f"unknown predicate {kind!r}")
    return of[kind]()


LEAVES: dict[str, Callable[[dict], Column]] = {
    "field_change": _field_change, "field_value": _value, "operation": _operation, "object": _object, "outside_hours": _outside_hours, "flag": _flag,
    "transaction": _transaction, "user_behavior": _behaviour, "fidelity": _fidelity,
}


def compiled(rule: dict) -> tuple[Column, Column, Column]:
    """(outcome, score, severity) of a rule. Too deep or too many leaves, and unknown names, raise ``ValueError``."""
    leaves: list[Column] = []

    def build(node: dict, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise ValueError("rule is nested too deeply")
        for name, join in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
            if name in node:
                return reduce(join, [build(x, depth + 1) for x in node[name]])
        if "not" in node:
            return ~build(node["not"], depth + 1)
        if node.get("leaf") not in LEAVES:
            raise ValueError(f"unknown leaf {node.get('leaf')!r}")
        leaves.append(LEAVES[node["leaf"]](node))
        if len(leaves) > MAX_LEAVES:
            raise ValueError("rule has too many leaves")
        return F.coalesce(leaves[-1], F.lit(False))

    tree = build(rule["when"], 1)
    undecided = reduce(lambda a, b: a | b, [x.isNull() for x in leaves])
    outcome = F.when(undecided, "INDETERMINATE").when(tree, "FIRED").otherwise("NOT_FIRED")
    score = F.lit(int(rule.get("base", 0)))
    for m in rule.get("modifiers", []):
        score = score + F.when(build(m["when"], 1), int(m["add"])).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(int(rule.get("max", 100))), score))
    return outcome, F.when(outcome == "FIRED", score).otherwise(0), severity(score)


def severity(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out


def evaluated(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per event and rule: the events' columns, rule_id, outcome, score, severity."""
    results = []
    for rule in rules:
        outcome, score, band = compiled(rule)
        results.append(F.struct(F.lit(rule["id"]).alias("rule_id"), outcome.alias("outcome"), score.alias("score"), F.when(outcome == "FIRED", band).alias("severity")))
    return events.select("*", F.explode(F.array(*results)).alias("_r")).select(*events.columns, "_r.*")


def tumbling(events: DataFrame, by: list[str], ts: str, seconds: int, least: int, value: str | None = None) -> DataFrame:
    """Windows of fixed length with at least ``least`` events: by, window_start, n, rate (events a second), and the exact sum and distinct count of ``value``."""
    metrics = [F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / seconds).alias("rate")]
    if value:
        metrics += [F.sum(F.col(value).cast("decimal(38,6)")).alias("total"), F.count_distinct(value).alias("distinct")]
    return events.groupBy(*by, F.window(ts, f"{seconds} seconds").alias("w")).agg(*metrics).where(F.col("n") >= least).select(*by, F.col("w.start").alias("window_start"), *[m for m in ("n", "rate", "total", "distinct") if m in ("n", "rate") or value])


def sliding(events: DataFrame, by: list[str], ts: str, seconds: int, least: int, id_: str = "event_id") -> DataFrame:
    """Events at which ``least`` events of their group lie in the seconds up to and with them: by, id, n.

    A group's timeline is cut into blocks as long as the window, so an event
    counts its own block up to itself and the tail of the block before: a window
    function over (group, block) with the block before copied in. No group, only
    two window lengths of one, meets in one task.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    rows = events.select(*by, id_, at.alias("_t"), F.floor(at / span).cast("bigint").alias("_b"))
    both = rows.select("*", F.explode(F.array(F.struct(F.col("_b").alias("k"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("k"), F.lit(False).alias("own")))).alias("c"))
    order = Window.partitionBy(*by, "c.k").orderBy("_t").rangeBetween(-span, 0)
    return both.select(*by, id_, F.col("c.own").alias("own"), F.count(F.lit(1)).over(order).alias("n")).where(F.col("own") & (F.col("n") >= least)).select(*by, id_, "n")


def related(events: DataFrame, other: DataFrame | None, on: list[str], name: str, having: Column | None = None) -> DataFrame:
    """Adds a flag whether related rows exist, optionally of those that satisfy ``having``; null if the other table isn't available."""
    if other is None:
        return events.withColumn(name, F.lit(None).cast("boolean"))
    keys = (other if having is None else other.where(having)).select(*on).distinct().withColumn(name, F.lit(True))
    return events.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def field_compared(events: DataFrame, other: DataFrame | None, on: list[str], name: str, own: str, op: str, field: str) -> DataFrame:
    """Adds a flag whether a related row's ``field`` compares so with the event's ``own``; null if the other table isn't available.

    Of the related rows only the least and greatest value and, for equality, the
    distinct ones are joined, so an event never meets all related rows.
    """
    if other is None:
        return events.withColumn(name, F.lit(None).cast("boolean"))
    if op in ("==",):
        keys = other.select(*on, F.col(field).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn(name, F.lit(True))
        left = events.withColumn("_v", F.col(own))
        return left.join(keys, [*on, "_v"], "left").select(*events.columns, F.coalesce(name, F.lit(False)).alias(name))
    ends = other.groupBy(*on).agg(F.min(field).alias("_least"), F.max(field).alias("_most"))
    test = {">": F.col(own) > F.col("_least"), ">=": F.col(own) >= F.col("_least"), "<": F.col(own) < F.col("_most"), "<=": F.col(own) <= F.col("_most"), "!=": (F.col("_least") != F.col(own)) | (F.col("_most") != F.col(own))}
    if op not in test:
        raise ValueError(f"unknown operator {op!r}")
    return events.join(ends, on, "left").select(*events.columns, F.coalesce(test[op], F.lit(False)).alias(name))


def known_actors(events: DataFrame, hosts: DataFrame, lookback_ms: int) -> DataFrame:
    """Adds new_actor (not seen in the lookback_ms before) and unusual_host (a host not known of the actor).

    events: actor, client_host, at_ms; hosts: actor, client_host. Without an
    actor both are false. Looking back goes by blocks, so a busy actor isn't one task.
    """
    times = events.where(F.col("actor").isNotNull() & F.col("at_ms").isNotNull()).select("actor", "at_ms").distinct().withColumn("_block", F.floor(F.col("at_ms") / lookback_ms).cast("bigint"))
    seen = carry(times, ["actor"], "_block", ["at_ms"], {"_prev": F.col("at_ms")}).select("actor", "at_ms", (F.col("_prev").isNull() | (F.col("at_ms") - F.col("_prev") > lookback_ms)).alias("new_actor"))
    usual = hosts.select("actor", "client_host").distinct().withColumn("_usual", F.lit(True))
    out = events.join(seen, ["actor", "at_ms"], "left").join(usual, ["actor", "client_host"], "left")
    unusual = F.col("actor").isNotNull() & F.col("client_host").isNotNull() & F.col("_usual").isNull()
    return out.withColumn("new_actor", F.coalesce("new_actor", F.lit(False))).withColumn("unusual_host", unusual).drop("_usual")


def event_scores(results: DataFrame, by: list[str], share: float = 0.25) -> DataFrame:
    """Score of each event over its fired rules: the greatest, plus ``share`` of the sum of the others, at most 100."""
    fired = results.where("outcome = 'FIRED'")
    total = fired.groupBy(*by).agg(F.max("score").alias("top"), F.sum("score").alias("all"))
    return total.select(*by, F.least(F.lit(100.0), F.col("top") + share * (F.col("all") - F.col("top"))).alias("event_score"))


def decayed(results: DataFrame, actor: str, at_ms: str, now_ms: int, window_ms: int, half_life_ms: int) -> DataFrame:
    """Score of each actor in the last window_ms, each event's halved for every half_life_ms of its age."""
    age = F.lit(now_ms) - F.col(at_ms)
    recent = results.where((age >= 0) & (age <= window_ms))
    return recent.groupBy(actor).agg(F.sum(F.col("score") * F.pow(F.lit(2.0), -age / half_life_ms)).alias("actor_score"))


def suppressed(alerts: DataFrame, key: str, at_ms: str, cooldown_ms: int) -> DataFrame:
    """Alerts after suppression: key, first_ms, last_ms, occurrences.

    An alert within cooldown_ms of the last one of its key joins it and restarts
    the cooldown, so each run ends where a step exceeds it: gaps and islands.
    """
    # a key's timeline is looked back over in blocks, so a key that raises most alerts isn't one task
    block = F.floor(F.col("_at") / (16 * max(1, cooldown_ms))).cast("bigint")
    once = alerts.where(F.col(at_ms).isNotNull()).groupBy(key, F.col(at_ms).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", block)
    once = once.withColumn("_key", F.struct(F.col(key).alias("k")))
    seen = carry(once, ["_key"], "_block", ["_at"], {"_prev": F.col("_at")})
    opens = seen.withColumn("_open", F.when(F.coalesce(F.col("_at") - F.col("_prev") > cooldown_ms, F.lit(True)), F.col("_at")))
    runs = carry(opens, ["_key"], "_block", ["_at"], {"_run": F.col("_open")}, inclusive=True)
    return runs.groupBy(key, "_run").agg(F.min("_at").alias("first_ms"), F.max("_at").alias("last_ms"), F.sum("_n").alias("occurrences")).drop("_run")


def cooled(alerts: DataFrame, key: str, at_ms: str, cooldown_ms: int) -> DataFrame:
    """As ``suppressed``, but the cooldown runs from the alert that opened it: a fold. key, at_ms, emitted."""

    def step(state, row):
        opens = state is None or row[1] - state > cooldown_ms
        return (row[1] if opens else state), (opens,)

    return fold(alerts, key, [at_ms], [], "emitted boolean", step)
