"""Ordered look-back and look-ahead that survives a hot key.

A plain window sorts all rows of one key in one task. Here a key's timeline is
cut into blocks (a log file, a month): the window runs inside a block, and what
crosses a block's border is carried by one summary row per key and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(df: DataFrame, keys: list[str], block: str, order: list[str], columns: dict[str, Column], *, inclusive: bool = False, backwards: bool = False) -> DataFrame:
    """Adds, for each name, the last non-null value of its expression before the row.

    inclusive: the row itself counts. backwards: the first value after the row
    instead. keys, block and order must not be null and (keys, order) must be
    unique, with order refining block.
    """
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    best = F.min_by if backwards else F.max_by
    first = Window.unboundedPreceding
    inside = Window.partitionBy(*keys, block).orderBy(*[way(c) for c in order]).rowsBetween(first, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy(way(block)).rowsBetween(first, -1)
    at = F.struct(*order)
    summary = df.groupBy(*keys, block).agg(*[best(x, F.when(x.isNotNull(), at)).alias(f"{n}__last") for n, x in columns.items()])
    summary = summary.select(*keys, block, *[F.last(f"{n}__last", ignorenulls=True).over(across).alias(f"{n}__over") for n in columns])
    out = df.select("*", *[F.last(x, ignorenulls=True).over(inside).alias(f"{n}__in") for n, x in columns.items()]).join(summary, [*keys, block], "left")
    return out.select(*df.columns, *[F.coalesce(f"{n}__in", f"{n}__over").alias(n) for n in columns])


def numbered(df: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's number (from 0) in its key's order, counted inside blocks and offset by the counts of earlier blocks."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, block, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    return df.withColumn("_in", F.row_number().over(inside) - 1).join(counts, [*keys, block]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], schema: str, step: Callable[[Any, tuple], tuple[Any, tuple]]) -> DataFrame:
    """A sequential fold over each key's rows in order.

    ``step(state, row)`` gives the next state and the row's results; the state is
    None at a key's first row. Rows stream through in Arrow batches: a task holds
    one batch and one state, never a whole key. Only for what can't be computed in
    another way (hash chains, caps that depend on when a segment opened): a key's
    rows pass through one task, however many tasks the others use.
    """
    slim = df.select(key, *order, *columns).repartition(key).sortWithinPartitions(key, *order)
    names = [part.split()[0] for part in schema.split(",")]
    width = 1 + len(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = object()
        state = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != current:
                    current, state = row[0], None
                state, result = step(state, row)
                out.append((*row[:width], *result))
            yield pd.DataFrame(out, columns=[key, *order, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:width])
    return slim.mapInPandas(run, f"{kinds}, {schema}")
