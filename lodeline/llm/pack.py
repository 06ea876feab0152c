"""Problem 7: filling containers of fixed capacity, by multiway differencing.

Karmarkar-Karp for k windows: the two partial partitions with the greatest
spread (largest minus smallest window) are merged with opposing order, the
fullest window of one with the emptiest of the other, until one partition is
left, whose windows are near equal.

Windows that are near equal over all items aren't full ones: the largest items
meet the smallest, though these could have been left to smaller gaps. So items
are differenced within size classes: a class is the largest items left, one for
each of its windows, with runs of like items that fill what room these leave, the
largest first. Differencing such a class gives windows that are equal and full. A
run that takes a window above the capacity gives way to one of smaller items; in
the last class the number of windows rises until none is above. An item larger
than the capacity is cut into full containers and a rest; no other is split.

Differencing is sequential, so items are dealt into shards of bounded size by a
hash of their id and each shard is packed on its own; a shard wastes less than
one container for having an end, so the waste falls with the shard's size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.tokens import RANKS, token_counts
from lodeline.session import bounded_rows

#: Items of a shard, on average; bounds the memory and time of one task's group.
SHARD = 10_000
#: Windows of a class: more make classes wider and windows less full.
WIDTH = 8
#: Rows of pack_budget, a fixed table.
MAX_BUDGETS = 100


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts ``sizes`` (positive) into k windows: (window of each item, sums of the windows).

    A partition holds only its non-empty windows, in falling order of their
    sums; windows are nodes of a forest whose leaves are the items.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    nodes = n
    parts: list[tuple[np.ndarray, np.ndarray]] = [(sizes[i : i + 1], np.array([i])) for i in range(n)]
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())] if k > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (a, an), (b, bn) = parts[x], parts[y]
        parts[y] = None
        both = len(a) + len(b) - k
        if both <= 0:
            sums, names = np.concatenate([a, b]), np.concatenate([an, bn])
        else:
            # the smallest `both` of a meet the smallest of b in opposing order
            keep = k - len(b)
            joined = np.arange(nodes, nodes + both)
            left[joined], right[joined] = an[keep:], bn[::-1][:both]
            nodes += both
            sums = np.concatenate([a[:keep], a[keep:] + b[::-1][:both], b[: len(b) - both]])
            names = np.concatenate([an[:keep], joined, bn[: len(b) - both]])
        order = np.argsort(-sums, kind="stable")
        parts[x] = sums, names = sums[order], names[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, x))
    sums, names = parts[heap[0][1]]
    window = np.full(2 * n, -1)
    window[names] = np.arange(len(names))
    for node in range(nodes - 1, n - 1, -1):
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], sums


def rising(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows): differenced into the least number that could do; it rises while a window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        # with as many windows as items each is alone, so there is an end
        window, sums = differencing(sizes, min(k, len(sizes)))
        if sums.max() <= capacity:
            return window, len(sums)
        k += 1


def windows(sizes: np.ndarray, capacity: int, width: int = WIDTH) -> np.ndarray:
    """The window of each item, none above ``capacity``; sizes are positive and at most the capacity. width: windows of a class."""
    out = np.zeros(len(sizes), np.int64)
    rest = np.argsort(sizes, kind="stable")
    used = 0
    while len(rest):
        value = sizes[rest]
        if len(rest) <= 2 * width or int(value.sum()) <= 2 * width * capacity:
            window, k = rising(value, capacity)
            out[rest] = used + window
            break
        free = np.ones(len(rest), bool)
        own = np.arange(len(rest) - width, len(rest))
        window = np.arange(width)
        while True:
            free[own] = False
            left = np.flatnonzero(free)
            m = min(width, len(left))
            totals = np.concatenate([[0], np.cumsum(value[left])])
            # the run of the largest like items that the class has room for, then ever smaller ones
            at = int(np.searchsorted(totals[m:] - totals[:-m], width * capacity - int(value[own].sum()), side="right")) - 1 if m else -1
            step = 1
            while at >= 0:
                both = np.concatenate([own, left[at : at + m]])
                found, sums = differencing(value[both], width)
                if sums.max() <= capacity:
                    break
                at, step = at - step, 2 * step
            if at < 0:
                break
            own, window = both, found
        out[rest[own]] = used + window
        used += width
        rest = rest[free]
    return out


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all items: (container, item, first token, tokens).

    Containers are numbered from 0. Items of no size share the first container.
    """
    sizes = np.asarray(sizes, np.int64)
    item = np.arange(len(sizes))
    full = sizes // capacity
    rest = sizes - full * capacity
    whole = np.repeat(item, full)
    first = (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    open_ = np.flatnonzero(rest > 0)
    window = windows(rest[open_], capacity)
    used = int(window.max()) + 1 if len(window) else 0
    empty = np.flatnonzero(sizes == 0)
    container = np.concatenate([window, used + np.arange(len(whole)), np.zeros(len(empty), np.int64)])
    return (
        container,
        np.concatenate([open_, whole, empty]),
        np.concatenate([full[open_] * capacity, first, np.zeros(len(empty), np.int64)]),
        np.concatenate([rest[open_], np.full(len(whole), capacity), np.zeros(len(empty), np.int64)]),
    )


def assign(items: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens", shard: int = SHARD, count: int | None = None) -> DataFrame:
    """Containers of every item for every budget.

    Columns: budget_id, capacity_tokens, container_id (unique within a budget),
    key, first_token, tokens. Items with a null key or size are left out; a size
    below 0 counts as 0; budgets without a positive capacity are left out. No
    items, no rows. count: how many items there are, where counting them would
    compute their sizes twice; it only sets the number of shards.
    """
    wanted = sorted({(r["budget_id"], r["capacity_tokens"]) for r in bounded_rows(budgets, MAX_BUDGETS, "pack_budget") if r["budget_id"] is not None and (r["capacity_tokens"] or 0) > 0})
    rows = items.where(F.col(key).isNotNull() & F.col(size).isNotNull()).select(F.col(key).alias("item"), F.greatest(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    if count is None:
        count = rows.count()
    shards = max(1, -(-count // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    kind = items.schema[key].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        first = int(group["shard"].iloc[0]) << 32
        out = []
        for budget, capacity in wanted:
            container, item, start, tokens = pack(group["size"].to_numpy(), capacity)
            out.append(pd.DataFrame({"budget_id": budget, "capacity_tokens": capacity, "container_id": first + container, "item": group["item"].to_numpy()[item], "first_token": start, "tokens": tokens}))
        return pd.concat(out) if out else pd.DataFrame(columns=["budget_id", "capacity_tokens", "container_id", "item", "first_token", "tokens"])

    # the rows are few bytes and much work: a number of partitions that isn't coalesced
    packed = rows.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(fill, f"budget_id int, capacity_tokens int, container_id bigint, item {kind}, first_token bigint, tokens bigint")
    return packed.withColumnRenamed("item", key)


def pack_documents(documents: DataFrame, budgets: DataFrame, path: str = RANKS) -> DataFrame:
    """Documents, sized in tokens, in containers of every budget; null and empty texts have size 0."""
    return assign(token_counts(documents, path=path), budgets, count=documents.count())


def fill_report(assigned: DataFrame) -> DataFrame:
    """For each budget: containers, tokens, unused tokens and the share of space used."""
    total = assigned.groupBy("budget_id", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    space = F.col("containers") * F.col("capacity_tokens")
    return total.select("*", (space - F.col("tokens")).alias("unused"), (F.col("tokens") / space).alias("used_share"))
