"""Problem 7: filling containers of fixed capacity.

Karmarkar-Karp multiway differencing, block by block: partial partitions are merged with opposing
imbalances, largest spread first, which gives nearly equal windows; the number of windows rises while
one exceeds the capacity.
"""

from __future__ import annotations

import heapq
import math
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are differenced together: a block of them leaves at most part of a container unused beyond the even fill.
BLOCK = 1000


_SIZE = itemgetter(0)


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Items 0..n-1 in at most k windows of nearly equal size, as (size, items); empty windows are left out."""
    if not sizes:
        return []
    # a partial partition is its non-empty windows, largest first; members are trees of items
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = [*a, *b]
        else:  # the smallest of one meet the smallest of the other, in opposing order
            pairs = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
            merged = [*a[: len(a) - over], *b[: len(b) - over], *pairs]
        merged.sort(key=_SIZE, reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        n += 1
        heapq.heappush(heap, (least - merged[0][0], n, merged))
    out = []
    for size, tree in heap[0][2]:
        items, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                items.append(t)
        out.append((size, items))
    return out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, none above the capacity, in windows that keep it."""
    if not sizes:
        return []
    low = max(1, math.ceil(sum(sizes) / capacity))
    step, k, best = 1, low, None
    while best is None:  # the count rises in growing steps while a window exceeds the capacity ...
        windows = difference(sizes, k)
        if windows[0][0] <= capacity:
            best = windows
        else:
            low, k, step = k + 1, k + step, 2 * step
    high = k
    while low < high:  # ... and the last step is searched for the least that does
        k = (low + high) // 2
        windows = difference(sizes, k)
        if windows[0][0] <= capacity:
            high, best = k, windows
        else:
            low = k + 1
    return [items for _, items in best]


def pack(sized: DataFrame, windows: DataFrame, key: str, block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """(window_name, container_id, key, part_no, tokens) for (key, tokens) and each (window_name, capacity_tokens).

    Only an item larger than the capacity is divided: into full containers and a rest that is packed with
    others. Items of no size are placed like any other. Blocks are cut by hash, so that they are alike and
    none grows with the data; ``windows`` is a table of a few rows. Null keys, sizes or capacities and
    capacities below 1 give no row; ``rows``, where known, saves counting the items, which measures them a second time; a key that comes again is an item of its own. An empty table gives none.
    """
    kind = sized.schema[key].dataType.simpleString()
    items = sized.where(F.col(key).isNotNull() & F.col("tokens").isNotNull()).select(F.col(key).alias("_k"), "tokens")
    blocks = max(1, math.ceil((items.count() if rows is None else rows) / block))
    work = items.withColumn("_block", F.pmod(F.xxhash64("_k"), F.lit(blocks))).crossJoin(F.broadcast(windows.where("window_name is not null and capacity_tokens > 0").select("window_name", "capacity_tokens")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity, name, at = int(group["capacity_tokens"].iloc[0]), group["window_name"].iloc[0], int(group["_block"].iloc[0])
        parts = []  # (key, part_no, tokens)
        full = []
        for k, size in sorted(zip(group["_k"], group["tokens"]), key=lambda r: (-r[1], str(r[0]))):
            whole = (size - 1) // capacity if size > capacity else 0
            full += [(k, i + 1, capacity) for i in range(whole)]
            parts.append((k, whole + 1, size - whole * capacity))
        containers = [[p] for p in full] + [[parts[i] for i in w] for w in fill([p[2] for p in parts], capacity)]
        rows = [(name, at * 10_000_000 + n, *p) for n, c in enumerate(containers) for p in c]
        return pd.DataFrame(rows, columns=["window_name", "container_id", "_k", "part_no", "tokens"])

    return work.groupBy("window_name", "_block").applyInPandas(run, f"window_name string, container_id long, _k {kind}, part_no int, tokens long").withColumnRenamed("_k", key)


def packing_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, containers, tokens, unused_share, fullest) per window."""
    used = packed.groupBy("window_name", "container_id").agg(F.sum("tokens").alias("used")).groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return used.join(F.broadcast(windows), "window_name").select("window_name", "capacity_tokens", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"), "fullest")
