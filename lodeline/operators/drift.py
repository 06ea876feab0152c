"""Problem 2: schemas that drift between files.

Versions of an object are the log files in which it has after-images. Columns
are profiled per version (types, images). Where a field leaves and another
arrives between neighbouring versions, either may have been written long before
or after: the old field's spell reaches back to where the new one was last seen,
the new field's spell forward to where the old one is seen again. Over its spell
each column gets a value sketch (a theta sketch of key and value). Sketches that
intersect, like types and the names' similarity nominate and weigh the pairs;
an equality join on key and value confirms them; a bipartite matching per
transition picks the renames; and matched columns are unified under their latest
name. The table is read once for the profile and once for the spells' values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.changes import key_columns, position, row_key
from lodeline.session import cut_lineage

VERSION = ["db_id", "object", "file_no"]

#: A theta sketch of the default size holds so many values exactly.
EXACT = 4096

#: Bits of a field's types.
TYPES = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}


def _images(changes: DataFrame) -> DataFrame:
    return position(changes.where(F.col("after_image").isNotNull())).select(*VERSION, "binlog_file", "after_image")


def _members(image: Column) -> Column:
    return F.from_json(image, "map<string,variant>")


def _type_bits(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), 0)
        .when(name == "STRING", TYPES["string"]).when(name == "BOOLEAN", TYPES["boolean"])
        .when(name.startswith("OBJECT"), TYPES["object"]).when(name.startswith("ARRAY"), TYPES["array"])
        .otherwise(TYPES["number"])
    )


def profile(changes: DataFrame) -> DataFrame:
    """One row per version and field: VERSION, binlog_file, field, types (bits), n (images), filled (non-null values).

    All deliveries count, repeats too. Images that aren't JSON objects have no
    fields. Everything is a sum, an or or a minimum, so it is aggregated before
    the shuffle and no version is hot.
    """
    each = _images(changes).select(*VERSION, "binlog_file", F.explode(_members(F.col("after_image"))).alias("field", "value"))
    bits = _type_bits(F.col("value"))
    return each.groupBy(*VERSION, "field").agg(F.min("binlog_file").alias("binlog_file"), F.bit_or(bits).alias("types"), F.count(F.lit(1)).alias("n"), F.count_if(bits != 0).alias("filled"))


def transitions(profiles: DataFrame) -> DataFrame:
    """One row per version that has a previous one: VERSION, binlog_file, prev_no, fields and before.

    fields and before (those of the previous version) map a field to its types
    and the numbers of the nearest other versions that have it (earlier, later).
    The maps are as wide as the object's schema; a version is one row.
    """
    own = Window.partitionBy("db_id", "object", "field").orderBy("file_no")
    seen = profiles.select("*", F.struct("types", F.lag("file_no").over(own).alias("earlier"), F.lead("file_no").over(own).alias("later")).alias("what"))
    versions = seen.groupBy(*VERSION).agg(F.min("binlog_file").alias("binlog_file"), F.map_from_entries(F.collect_list(F.struct("field", "what"))).alias("fields"))
    order = Window.partitionBy("db_id", "object").orderBy("file_no")
    return versions.select("*", F.lag("file_no").over(order).alias("prev_no"), F.lag("fields").over(order).alias("before")).where(F.col("prev_no").isNotNull())


def _lost() -> Column:
    return F.filter(F.map_keys("before"), lambda k: ~F.map_contains_key("fields", k))


def _new() -> Column:
    return F.filter(F.map_keys("fields"), lambda k: ~F.map_contains_key("before", k))


def open_pairs(moves: DataFrame) -> DataFrame:
    """Every pair of a field that leaves and one that arrives at a transition.

    Columns: db_id, object, into (the version), lost, new, since (the last
    version before that has the new field, or null) and until (the next that has
    the lost one, or null). As many rows as the schemas' changes have pairs.
    """
    pairs = moves.select("db_id", "object", F.col("file_no").alias("into"), "fields", "before", _lost().alias("lost"), _new().alias("new")).where((F.size("lost") > 0) & (F.size("new") > 0))
    return pairs.withColumn("lost", F.explode("lost")).withColumn("new", F.explode("new")).select("db_id", "object", "into", "lost", "new", F.col("fields")[F.col("new")]["earlier"].alias("since"), F.col("before")[F.col("lost")]["later"].alias("until"))


def _spells(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """What to read of each version: VERSION, wanted (structs of field, into, side). Metadata only: versions and fields, no rows."""
    on = ["db_id", "object", "into"]
    lost = pairs.groupBy(*on, F.col("lost").alias("field")).agg(F.min(F.coalesce("since", F.lit(-1))).alias("low")).select(*on, "field", F.lit("lost").alias("side"), "low", (F.col("into") - 1).alias("high"))
    new = pairs.groupBy(*on, F.col("new").alias("field")).agg(F.max(F.coalesce("until", F.lit(2**62))).alias("high")).select(*on, "field", F.lit("new").alias("side"), (F.col("into") - 1).alias("low"), (F.col("high") - 1).alias("high"))
    sides = lost.unionByName(new)
    inside = profiles.select(*VERSION, "field").join(sides, ["db_id", "object", "field"]).where((F.col("file_no") > F.col("low")) & (F.col("file_no") <= F.col("high")))
    return inside.groupBy(*VERSION).agg(F.collect_list(F.struct("field", "into", "side")).alias("wanted"))


def _value_text(value: Column) -> Column:
    """A value as text that is equal for equal values: members of objects are in order, numbers without trailing zeros; long values by their digest."""
    text = F.to_json(value)
    text = F.when(text.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(F.length(text) > 100, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def spell_cells(changes: DataFrame, monitored: DataFrame, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The distinct values that rows have in the spells of the pairs' fields.

    Columns: db_id, object, into, side, field, row_key, value, type (bits),
    first and last (versions in which the row is written so). Null members and
    images without their key are left out.
    """
    keys = key_columns(monitored)
    images = _images(changes).join(_spells(pairs, profiles), VERSION)
    each = images.select(
        *VERSION, "wanted", row_key(F.col("after_image"), F.col("object"), keys).alias("row_key"),
        F.explode(F.map_filter(_members(F.col("after_image")), lambda k, v: F.exists("wanted", lambda w: w["field"] == k))).alias("field", "value"),
    ).where(F.col("row_key").isNotNull() & ~F.is_variant_null("value"))
    each = each.select(*VERSION, "row_key", "field", _value_text(F.col("value")).alias("value"), _type_bits(F.col("value")).alias("type"), F.explode(F.filter("wanted", lambda w: w["field"] == F.col("field"))).alias("w"))
    return each.groupBy("db_id", "object", F.col("w.into").alias("into"), F.col("w.side").alias("side"), "field", "row_key", "value").agg(F.bit_or("type").alias("type"), F.min("file_no").alias("first"), F.max("file_no").alias("last"))


def nominated(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose columns may share a value: pairs' columns, shared (estimate), least (values of the smaller column), same_type, name_distance.

    A pair is dropped only where no row can keep its value: where the types have
    nothing in common, or both sketches are exact and don't intersect. A sketch
    that is too full to be exact proves nothing, so it nominates; nothing is lost
    by sketching.
    """
    on = ["db_id", "object", "into"]
    columns = cells.groupBy(*on, "side", "field").agg(F.theta_sketch_agg(F.xxhash64("row_key", "value")).alias("sketch"), F.count(F.lit(1)).alias("n"), F.bit_or("type").alias("types"))
    side = lambda name, x: columns.where(F.col("side") == name).select(*on, F.col("field").alias(name), F.col("sketch").alias(f"{x}s"), F.col("n").alias(f"{x}n"), F.col("types").alias(f"{x}t"))
    both = pairs.join(side("lost", "a"), [*on, "lost"]).join(side("new", "b"), [*on, "new"])
    shared = F.theta_sketch_estimate(F.theta_intersection("as", "bs"))
    both = both.where(F.col("at").bitwiseAND(F.col("bt")) != 0).withColumn("shared", shared).where((F.col("shared") > 0) | (F.greatest("an", "bn") > EXACT))
    return both.select(
        *on, "lost", "new", "since", "until", "shared", F.least("an", "bn").alias("least"),
        (F.col("at") == F.col("bt")).alias("same_type"), F.levenshtein(F.lower("lost"), F.lower("new")).alias("name_distance"),
    )


def evidence(changes: DataFrame, monitored: DataFrame, profiles: DataFrame, moves: DataFrame) -> DataFrame:
    """Pairs of a lost and a new field with rows that keep their value.

    Columns: VERSION, lost, new, kept (rows), common (the lesser number of values
    of the two columns), same_type, name_distance. The join is by equality of key
    and value; a row counts if it is written so inside both spells of the pair.
    """
    on = ["db_id", "object", "into"]
    pairs = open_pairs(moves)
    cells = cut_lineage(spell_cells(changes, monitored, pairs, profiles))
    found = nominated(cells, pairs)
    lost = cells.where("side = 'lost'").select(*on, F.col("field").alias("lost"), "row_key", "value", "last")
    new = cells.where("side = 'new'").select(*on, F.col("field").alias("new"), "row_key", "value", "first")
    kept = lost.join(new, [*on, "row_key", "value"]).join(found.select(*on, "lost", "new", "since", "until"), [*on, "lost", "new"])
    kept = kept.where((F.col("since").isNull() | (F.col("last") > F.col("since"))) & (F.col("until").isNull() | (F.col("first") < F.col("until"))))
    kept = kept.groupBy(*on, "lost", "new").agg(F.count_distinct("row_key").alias("kept"))
    return found.join(kept, [*on, "lost", "new"]).select("db_id", "object", F.col("into").alias("file_no"), "lost", "new", "kept", F.greatest("least", "kept").alias("common"), "same_type", "name_distance")


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching; weights of 0 are no edges. Hungarian algorithm on the padded square."""
    rows, columns = len(weights), len(weights[0]) if weights else 0
    n = max(rows, columns)
    cost = [[-weights[i][j] if i < rows and j < columns else 0.0 for j in range(n)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1) if match[j] - 1 < rows and j - 1 < columns and weights[match[j] - 1][j - 1] > 0]


def weight(kept: int, common: float, same_type: bool, distance: int, length: int) -> float:
    """Evidence first; type and name only decide between pairs of like evidence."""
    share = min(1.0, kept / common) if common else 0.0
    return 1.0 + share + 0.25 * min(1.0, kept / 8) + 0.2 * same_type + 0.1 * (1 - distance / max(1, length))


def renames(pairs: DataFrame) -> DataFrame:
    """One matching per transition: VERSION, lost, new."""

    def match(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["lost", "new"])
        lost, new = sorted(set(found["lost"])), sorted(set(found["new"]))
        weights = [[0.0] * len(new) for _ in lost]
        for r in found.itertuples():
            weights[lost.index(r.lost)][new.index(r.new)] = weight(r.kept, r.common, r.same_type, r.name_distance, max(len(r.lost), len(r.new)))
        first = found.iloc[0]
        return pd.DataFrame([(first["db_id"], first["object"], first["file_no"], lost[i], new[j]) for i, j in assignment(weights)], columns=["db_id", "object", "file_no", "lost", "new"])

    # a group is as large as the schema of one object
    return pairs.groupBy(*VERSION).applyInPandas(match, "db_id string, object string, file_no bigint, lost string, new string")


def versions(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile, written once to the shared folder (a row per version and field), and its transitions."""
    profiles = cut_lineage(profile(changes))
    return profiles, transitions(profiles)


def report(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """Each change of a field between an object's neighbouring versions.

    Columns: db_id, object_name, binlog_file, change_kind (added, removed,
    retyped, renamed), field_name, old_name ('' unless renamed). The first
    version has no changes. A field without non-null values has no type, so it
    isn't retyped; values of several types in one file are a type of their own.
    """
    profiles, moves = versions(changes)
    matched = renames(evidence(changes, monitored, profiles, moves)).groupBy(*VERSION).agg(F.collect_list(F.struct("lost", "new")).alias("pairs"))
    moves = moves.join(matched, VERSION, "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<lost:string,new:string>>")))
    case = lambda kind, name, old: F.struct(F.lit(kind).alias("change_kind"), name.alias("field_name"), old.alias("old_name"))
    none = F.lit("")
    kept = F.filter(F.map_keys("fields"), lambda k: F.map_contains_key("before", k))
    types = lambda fields, k: F.element_at(fields, k)["types"]
    differs = lambda k: (types("fields", k) != 0) & (types("before", k) != 0) & (types("fields", k) != types("before", k))
    cases = F.concat(
        F.transform("pairs", lambda p: case("renamed", p["new"], p["lost"])),
        F.transform(F.array_except(_new(), F.transform("pairs", lambda p: p["new"])), lambda k: case("added", k, none)),
        F.transform(F.array_except(_lost(), F.transform("pairs", lambda p: p["lost"])), lambda k: case("removed", k, none)),
        F.transform(F.filter(kept, differs), lambda k: case("retyped", k, none)),
    )
    return moves.select("db_id", F.col("object").alias("object_name"), "binlog_file", F.explode(cases).alias("c")).select("db_id", "object_name", "binlog_file", "c.*")


def latest_names(found: DataFrame) -> DataFrame:
    """The latest name of every renamed field: db_id, object, field, from_no, to_no, latest.

    from_no..to_no are the file numbers in which the field bore that name (to_no
    null: still). A group is one object's renames, as small as its schema's history.
    """

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("file_no")
        links: list[list] = []  # chains of [name, from, to]
        for r in group.itertuples():
            chain = next((c for c in links if c[-1][0] == r.lost and c[-1][2] is None), None)
            if chain is None:
                chain = [[r.lost, None, None]]
                links.append(chain)
            chain[-1][2] = r.file_no - 1
            chain.append([r.new, r.file_no, None])
        first = group.iloc[0]
        rows = [(first["db_id"], first["object"], name, start, end, c[-1][0]) for c in links for name, start, end in c]
        return pd.DataFrame(rows, columns=["db_id", "object", "field", "from_no", "to_no", "latest"]).astype({"from_no": "Int64", "to_no": "Int64"})

    return found.groupBy("db_id", "object").applyInPandas(follow, "db_id string, object string, field string, from_no bigint, to_no bigint, latest string")


def unified(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """Every after-image under the latest names of its fields.

    Columns: change_id, db_id, object_name, binlog_file, fields map<string,string>
    (values as text: strings as they are, other values as JSON). Missing and null
    members are left out of the map. Where two members of an image fall on one
    name, the one that bears it counts.
    """
    profiles, moves = versions(changes)
    names = latest_names(renames(evidence(changes, monitored, profiles, moves))).groupBy("db_id", "object").agg(F.collect_list(F.struct("field", "from_no", "to_no", "latest")).alias("names"))
    images = position(changes.where(F.col("after_image").isNotNull())).select("change_id", "db_id", "object", "binlog_file", "file_no", "after_image")
    rows = images.join(names, ["db_id", "object"], "left")
    values = F.map_filter(F.from_json("after_image", "map<string,string>"), lambda k, v: v.isNotNull())
    rows = rows.withColumn("values", values)
    hit = lambda k: F.filter(F.coalesce("names", F.array().cast("array<struct<field:string,from_no:bigint,to_no:bigint,latest:string>>")), lambda n: (n["field"] == k) & (n["from_no"].isNull() | (n["from_no"] <= F.col("file_no"))) & (n["to_no"].isNull() | (n["to_no"] >= F.col("file_no"))))
    latest = lambda k: F.coalesce(F.try_element_at(hit(k), F.lit(1))["latest"], k)
    moved = F.filter(F.transform(F.map_entries("values"), lambda e: F.struct(latest(e["key"]).alias("key"), e["value"].alias("value"), (latest(e["key"]) == e["key"]).alias("own"))), lambda e: e["own"] | ~F.map_contains_key("values", e["key"]))
    pairs = F.transform(moved, lambda e: F.struct(e["key"], e["value"]))
    return rows.select("change_id", "db_id", F.col("object").alias("object_name"), "binlog_file", F.map_from_entries(pairs).alias("fields"))


def p2_found(changes: DataFrame, monitored: DataFrame) -> DataFrame:
    """The report of each change of an object's fields."""
    return report(changes, monitored)
