"""Columns that every operator over ``normalized_change`` needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.session import bounded_rows

#: Rows of monitored_table that are accepted as a fixed dimension.
MAX_MONITORED = 10_000


def plain_object(name: Column) -> Column:
    """Object name in lower case, without quotes and without schema prefix."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[`\"\\[\\]]", ""), r"^.*\.", "")


def file_number(binlog_file: Column) -> Column:
    """Trailing number of a log file's name; files are ordered by it, not by text."""
    return F.regexp_extract(binlog_file, r"(\d+)\s*$", 1).cast("bigint")


def position(df: DataFrame) -> DataFrame:
    """Adds ``object`` and ``file_no``."""
    return df.withColumn("object", plain_object(F.col("object_name"))).withColumn("file_no", file_number(F.col("binlog_file")))


def key_columns(monitored: DataFrame) -> dict[str, list[str]]:
    """Key columns by plain object name; monitored_table is a fixed, small dimension."""
    rows = bounded_rows(monitored.select("object_name", "pk_columns"), MAX_MONITORED, "monitored_table")
    return {
        r["object_name"].strip().lower(): [c.strip() for c in r["pk_columns"].split(",")]
        for r in rows
        if r["object_name"] and r["pk_columns"]
    }


def member(image: Column, name: str) -> Column:
    """Text of a top-level member of a JSON image; null where missing or null."""
    return F.get_json_object(image, "$['" + name + "']")


def row_key(image: Column, obj: Column, keys: dict[str, list[str]]) -> Column:
    """Values of the object's key columns as text, joined by ``|``.

    Null where the image is null, a key member is missing or null, or the object
    isn't monitored. The expression stays in the JVM: one branch per distinct
    list of key columns.
    """
    by_columns: dict[tuple[str, ...], list[str]] = {}
    for name, columns in sorted(keys.items()):
        by_columns.setdefault(tuple(columns), []).append(name)
    out = None
    for columns, names in by_columns.items():
        parts: Iterable[Column] = [member(image, c) for c in columns]
        value = parts[0] if len(columns) == 1 else F.concat(*[x for p in parts for x in (p, F.lit("|"))][:-1])
        out = (F.when if out is None else out.when)(obj.isin(*names), value)
    return F.lit(None).cast("string") if out is None else out
