"""Problem 5: history of changing entity attributes.

Event-sourced log per attribute: every source is turned into observations
(an attribute of an entity was set, or the entity ended), observations into the
points at which the attribute's intervals begin and end. Each attribute has
intervals of its own (``attribute_log``); ``combined`` splits them at the union
of their boundaries and coalesces equal neighbours into versions of the entity.

Boundaries are places in the order of the source (a log position, a snapshot's
time) and carry their time as a label, so times that are missing, equal or out
of order move no boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.changes import key_columns, member, plain_object, position, row_key
from lodeline.operators.changelog import deduplicated
from lodeline.operators.ordered import carry
from lodeline.session import cut_lineage

ENTITY = ["origin", "db_id", "object_name", "entity_id", "attribute"]
OPEN = -1


def bare(value: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.regexp_replace(F.lower(value), r"^\s+|\s+$", "")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def observations_of_changes(changes: DataFrame, monitored: DataFrame, objects: list[str], attributes: list[str]) -> DataFrame:
    """Observations of the change feed, repeats taken out.

    An UPDATE under one key is one observation; one that moves a row to another
    key ends the old row and writes the new one. Changes without a usable key
    are left out; so are DDL and TRUNCATE, which carry no image of a row.
    Columns: ENTITY, block, at (order), ts (ms), ends, value, before.
    """
    keys = {k: v for k, v in key_columns(monitored).items() if k in objects}
    # the cheap name filter runs first, on the raw column, and images are only parsed for the rows it leaves
    source = position(changes.where(plain_object(F.col("object_name")).isin(*objects) & F.col("operation").isin("INSERT", "UPDATE", "DELETE")))
    of = lambda image: F.array(*[bare(member(F.col(image), a)) for a in attributes])
    once = deduplicated(
        source.select(
            "db_id", "object", "file_no", "binlog_pos", "row_no", "change_id", "operation", "commit_ts",
            row_key(F.col("before_image"), F.col("object"), keys).alias("old_key"),
            row_key(F.col("after_image"), F.col("object"), keys).alias("new_key"),
            of("before_image").alias("old"), of("after_image").alias("new"),
        )
    )
    writes = F.col("operation") != "DELETE"
    moved = writes & (F.col("operation") == "UPDATE") & (F.col("old_key") != F.col("new_key"))
    steps = F.filter(
        F.array(
            F.when(~writes | moved, F.struct(F.lit(0).alias("step"), F.col("old_key").alias("entity_id"), F.lit(True).alias("ends"))),
            F.when(writes, F.struct(F.lit(1).alias("step"), F.col("new_key").alias("entity_id"), F.lit(False).alias("ends"))),
        ),
        lambda x: x.isNotNull(),
    )
    each = once.select("*", moved.alias("moved"), F.explode(steps).alias("s")).where(F.col("s.entity_id").isNotNull())
    names = F.array(*[F.lit(a) for a in attributes])
    # a row that a change moves in under a new key has no value of its own before that change
    had = (F.col("operation") != "INSERT") & (F.col("s.ends") | ~F.coalesce("moved", F.lit(False)))
    return each.select(
        F.lit("changes").alias("origin"), "db_id", F.col("object").alias("object_name"), "s.entity_id", F.col("file_no").alias("block"),
        F.struct("file_no", "binlog_pos", "row_no", "s.step").alias("at"), millis(F.col("commit_ts")).alias("ts"), "s.ends",
        had.alias("had"), F.explode(F.arrays_zip(names.alias("attribute"), F.col("new").alias("value"), F.col("old").alias("before"))).alias("v"),
    ).select(
        "origin", "db_id", "object_name", "entity_id", "v.attribute", "block", "at", "ts", "ends",
        F.when(~F.col("ends"), F.col("v.value")).alias("value"), F.when(F.col("had"), F.struct(F.col("v.before").alias("value"))).alias("before"),
    )


def observations_of_snapshots(snapshots: DataFrame, object_name: str, entity: str, attributes: list[str]) -> DataFrame:
    """Observations of periodic snapshots.

    Of several rows with one snapshot_ts the one with the latest loaded_at
    counts (a null loaded_at counts as the earliest; equal times: the larger
    values). A null value and absence observe nothing. Rows without database,
    id or snapshot_ts are left out.
    """
    rows = snapshots.where(F.col("db_id").isNotNull() & F.col(entity).isNotNull() & F.col("snapshot_ts").isNotNull())
    values = F.struct(*[bare(F.col(a).cast("string")).alias(a) for a in attributes])
    once = rows.groupBy("db_id", F.col(entity).cast("string").alias("entity_id"), millis(F.col("snapshot_ts")).alias("ts")).agg(F.max_by(values, F.struct("loaded_at", values)).alias("x"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"x.{a}").alias("value")) for a in attributes]))
    month = 30 * 24 * 3600 * 1000
    return (
        once.select(F.lit("snapshots").alias("origin"), "db_id", F.lit(object_name).alias("object_name"), "entity_id", "ts", each.alias("v"))
        .where(F.col("v.value").isNotNull())
        .select(
            "origin", "db_id", "object_name", "entity_id", "v.attribute", F.floor(F.col("ts") / month).cast("bigint").alias("block"),
            F.struct(F.col("ts").alias("file_no"), F.lit(0).cast("bigint").alias("binlog_pos"), F.lit(0).alias("row_no"), F.lit(1).alias("step")).alias("at"),
            "ts", F.lit(False).alias("ends"), "v.value", F.lit(None).cast("struct<value:string>").alias("before"),
        )
    )


def boundaries(observations: DataFrame) -> DataFrame:
    """Where the intervals of each attribute begin and end: ENTITY, block, at (place), ts, opens, value.

    An interval begins at the observation that shows another value than the one
    before, that is the entity's first, or the first after its end; it ends
    where the next begins or where the entity ends. An entity whose first
    observation shows what it had before holds that value from -1. A null time
    of the change stays null. No observations, no rows.
    """
    seen = carry(observations, ENTITY, "block", ["at"], {"prev": F.struct("ends", "value")})
    had = F.when(F.col("prev").isNull() & F.col("before").isNotNull(), F.struct(F.lit(False).alias("ends"), F.col("before.value").alias("value")))
    seen = seen.withColumn("had", had).withColumn("last", F.coalesce("prev", "had"))
    alive = F.col("last").isNotNull() & ~F.col("last.ends")
    begins = ~F.col("ends") & (~alive | ~F.col("last.value").eqNullSafe(F.col("value")))
    point = lambda n, ts, value, open_: F.struct(F.lit(n).alias("n"), ts.cast("bigint").alias("ts"), F.lit(open_).alias("opens"), value.alias("value"))
    points = F.filter(
        F.array(
            F.when(F.col("had").isNotNull(), point(0, F.lit(OPEN), F.col("had.value"), True)),
            F.when(F.col("ends") & alive, point(1, F.col("ts"), F.lit(None).cast("string"), False)),
            F.when(begins, point(1, F.col("ts"), F.col("value"), True)),
        ),
        lambda x: x.isNotNull(),
    )
    each = seen.select(*ENTITY, "block", "at", F.explode(points).alias("p"))
    return each.select(*ENTITY, "block", F.struct("at.*", "p.n").alias("at"), F.col("p.ts").alias("ts"), F.col("p.opens").alias("opens"), F.col("p.value").alias("value"))


def attribute_log(points: DataFrame) -> DataFrame:
    """Intervals of each attribute: ENTITY, value, valid_from_ms, valid_to_ms; an open end is -1."""
    ended = carry(points, ENTITY, "block", ["at"], {"next": F.struct("ts")}, backwards=True)
    return ended.where("opens").select(*ENTITY, "value", F.col("ts").alias("valid_from_ms"), F.when(F.col("next").isNull(), F.lit(OPEN).cast("bigint")).otherwise(F.col("next.ts")).alias("valid_to_ms"))


def combined(points: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions of whole entities from the boundaries of their attributes.

    The attributes' intervals are split at the union of their boundaries;
    neighbours with the same values are one version; stretches in which no
    attribute has an interval are none. Columns: origin, db_id, object_name,
    entity_id, the attributes, valid_from_ms, valid_to_ms.
    """
    entity = [c for c in ENTITY if c != "attribute"]
    names = [f"s{i}" for i in range(len(attributes))]
    # what each attribute is from this place on; where one interval ends and the next begins, the beginning counts
    now = lambda a: F.max(F.when(F.col("attribute") == a, F.struct(F.col("opens").alias("on"), "value")))
    at = points.groupBy(*entity, "block", "at").agg(F.max("ts").alias("ts"), *[now(a).alias(f"a{i}") for i, a in enumerate(attributes)])
    if len(attributes) > 1:
        at = carry(at, entity, "block", ["at"], {n: F.col(f"a{i}") for i, n in enumerate(names)}, inclusive=True)
    else:
        at = at.withColumn("s0", F.col("a0"))
    state = F.struct(*[F.when(F.col(f"{n}.on"), F.struct(F.col(f"{n}.value").alias("value"))).alias(n) for n in names])
    full = at.select(*entity, "ts", "block", "at", state.alias("state"))
    full = carry(full, entity, "block", ["at"], {"prev": F.struct("state")}).where(F.col("prev").isNull() | ~F.col("prev.state").eqNullSafe(F.col("state")))
    full = carry(full.drop("prev"), entity, "block", ["at"], {"next": F.struct("ts")}, backwards=True)
    some = F.coalesce(*[F.col(f"state.{n}") for n in names]).isNotNull()
    return full.where(some).select(
        *entity, *[F.col(f"state.{n}.value").alias(a) for n, a in zip(names, attributes, strict=True)],
        F.col("ts").alias("valid_from_ms"), F.when(F.col("next").isNull(), F.lit(OPEN).cast("bigint")).otherwise(F.col("next.ts")).alias("valid_to_ms"),
    )


def versions(observations: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions of the entities observed. The observations and the boundaries are written once to the shared folder, as each is looked through twice."""
    return combined(cut_lineage(boundaries(cut_lineage(observations))), attributes)


def p5_found(changes: DataFrame, monitored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Versions of status of users and beneficiaries (changes) and of users (snapshots)."""
    seen = observations_of_changes(changes, monitored, ["users", "beneficiaries"], ["status"]).unionByName(observations_of_snapshots(snapshots, "users", "id", ["status"]))
    return versions(seen, ["status"]).select("origin", "db_id", "object_name", "entity_id", "valid_from_ms", "valid_to_ms")
