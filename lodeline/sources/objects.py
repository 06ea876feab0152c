"""Sealed objects, side tables and export packages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_prefix(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects below a key prefix: key, content; in order of the key."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{prefix}" if prefix else root)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("key"), "content").orderBy("key")


def hydrated(wanted: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted keys with their objects, keys without one). Keys that climb out of their folder are never found."""
    safe = wanted.where(~F.col("key").contains("..") & ~F.col("key").startswith("/"))
    return safe.join(objects, "key"), wanted.join(objects.select("key"), "key", "left_anti").unionByName(wanted.join(safe.select("key"), "key", "left_anti")).distinct()


#: Members of an export package and what they are; those with ``?`` may be missing.
PACKAGE = {
    "package_version": str, "package_id": str, "db_id": str, "purpose": str, "created_at": str, "created_by": str, "object_refs": list, "segment_manifests": list, "anchor_records": list, "public_keys": list,
    "export_signature?": dict, "case_reference?": str,
}
#: Members of each entry of a package's lists; where it is None an entry is JSON text.
ENTRIES = {"object_refs": ("object_id", "object_type", "worm_object_key", "event_hash"), "segment_manifests": None, "anchor_records": None, "public_keys": ("key_id", "algorithm", "public_key")}


def package(text: str) -> dict:
    """An export package as ``export.packages`` writes it, or ``ValueError``: unreadable, incomplete and unknown ones are never half accepted."""
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise ValueError("package is not an object")
    for name, kind in PACKAGE.items():
        bare = name.rstrip("?")
        if not (isinstance(doc.get(bare), kind) or (name.endswith("?") and bare not in doc)):
            raise ValueError(f"package has no {bare}")
    if unknown := set(doc) - {n.rstrip("?") for n in PACKAGE}:
        raise ValueError(f"package has unknown members: {sorted(unknown)}")
    for name, members in ENTRIES.items():
        for i, entry in enumerate(doc[name]):
            if members is None:
                entry = json.loads(entry) if isinstance(entry, str) else None
            if not isinstance(entry, dict) or (members and (set(entry) != set(members) or not all(isinstance(v, str) for v in entry.values()))):
                raise ValueError(f"{name}[{i}] is malformed")
    return doc


#: What a drill always holds, whatever its size: label, and (operation, object) of each change of one transaction.
SCENARIOS = (
    ("value-changed-after-approval", (("UPDATE", "gifts"),)), ("balance-edited-by-hand", (("UPDATE", "wallets"),)), ("owner-deleted-with-balance", (("DELETE", "people"),)), ("parent-deleted", (("DELETE", "campaigns"),)),
    ("role-granted", (("INSERT", "roles"), ("UPDATE", "people"))), ("mass-update", (("UPDATE", "gifts"),) * 25), ("schema-changed", (("DDL", "gifts"),)), ("table-emptied", (("TRUNCATE", "scratch"),)),
)


def drill(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """A feed for drills: every scenario as one transaction, then n inserts from hashes of their numbers: change_id, tx_id, label, operation, object, key."""
    fixed = [(i, f"drill-{t}", label, op, obj) for i, (t, label, op, obj) in enumerate(((t, label, op, obj) for t, (label, steps) in enumerate(SCENARIOS) for op, obj in steps), 1)]
    head = spark.createDataFrame(fixed, "change_id bigint, tx_id string, label string, operation string, object string").withColumn("key", F.pmod(F.xxhash64("change_id", F.lit(seed)), F.lit(1000)))
    first = len(fixed)
    tail = spark.range(first + 1, first + n + 1).select(F.col("id").alias("change_id"), F.concat(F.lit("load-"), "id").alias("tx_id"), F.lit("load").alias("label"), F.lit("INSERT").alias("operation"), F.lit("gifts").alias("object"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)).alias("key"))
    return head.unionByName(tail)


def generated_changes(spark: SparkSession, n: int, seed: int = 1, databases: int = 4) -> DataFrame:
    """n deterministic insert, update and delete events for load tests, from hashes of their numbers."""
    pick = lambda k, salt: F.pmod(F.xxhash64("change_id", F.lit(seed), F.lit(salt)), F.lit(k))
    op: Column = F.element_at(F.array(*[F.lit(x) for x in ("INSERT", "UPDATE", "UPDATE", "DELETE")]), (pick(4, "op") + 1).cast("int"))
    return spark.range(1, n + 1).withColumnRenamed("id", "change_id").select(
        "change_id", F.concat(F.lit("db-"), pick(databases, "db")).alias("db_id"), op.alias("operation"), pick(1000, "key").alias("key"), F.concat(pick(100_000, "amount"), F.lit(".00")).alias("amount")
    )
