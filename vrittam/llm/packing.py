"""Filling fixed-capacity containers with items: multiway differencing in bounded blocks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise, width

CAPACITY = 4096
#: Containers that one block fills, about, and items it has, about, at most. A block is one task's work.
WINDOWS, ITEMS = 48, 4000
MOST_TASKS = 20_000


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp with ``m`` windows: window of every item, and the window loads.

    Every partial partition is a list of loads; the two with the widest spread are merged so that the
    fullest window of one meets the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum()] * m)
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads = np.zeros(m, dtype=np.int64)
        loads[0] = s
        heap.append((-s, i, loads, [[i]] + [[] for _ in range(m - 1)]))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        loads = a + b[::-1]
        groups = [p + q if q else p for p, q in zip(x, reversed(y))]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        # the common floor takes no part in the spread
        heapq.heappush(heap, (-(int(loads[0]) - int(loads[-1])), tick, loads, [groups[k] for k in order]))
        tick += 1
    _, _, loads, groups = heap[0]
    window = np.empty(n, dtype=np.int64)
    for k, g in enumerate(groups):
        window[g] = k
    return window, loads


def fill_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every item (none larger than ``capacity``); the window count rises until none is over capacity.

    Items of a size that can share a window with no other one (capacity minus the smallest item) are
    set apart first.
    """
    window = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return window
    rest = np.arange(len(sizes))
    used = 0
    positive = sizes[sizes > 0]
    if len(positive):
        alone = rest[sizes > capacity - positive.min()]
        if len(alone) < len(rest):
            window[alone] = np.arange(len(alone))
            used, rest = len(alone), np.setdiff1d(rest, alone)
    m = max(1, math.ceil(sizes[rest].sum() / capacity))
    while True:
        got, loads = differencing(sizes[rest], m)
        if loads.max(initial=0) <= capacity:
            break
        m += max(1, m // 64)
    window[rest] = used + got
    # windows whose contents fit another's free space are dissolved by first fit, smallest first
    total = used + m
    load = np.bincount(window, sizes, total)
    for k in np.argsort(load, kind="stable"):
        members = np.flatnonzero(window == k)
        members = members[np.argsort(-sizes[members], kind="stable")]
        free = np.where(load > 0, capacity - load, -1.0)
        free[k] = -1
        goal = []
        for i in members:
            j = int(np.argmin(np.where(free >= sizes[i], free, np.inf)))
            if free[j] < sizes[i]:
                goal = None
                break
            goal.append(j)
            free[j] -= sizes[i]
        if goal:
            for i, j in zip(members, goal):
                window[i] = j
                load[j] += sizes[i]
            load[k] = 0
    return np.unique(window, return_inverse=True)[1]


def tasks(blocks: int, least: int) -> int:
    """Tasks that pack ``blocks`` blocks: about 16 each, ``least`` or more, a bounded number."""
    return max(1, min(max(blocks // 16, least), blocks, MOST_TASKS))


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """``id``, ``piece``, ``start``, ``size``, ``container``: every item in a container of ``capacity``.

    Only an item larger than the capacity is split: into full containers of their own and a rest,
    which is packed like an item. ``start`` is the offset of a piece in its item. Null and negative
    sizes count as 0; an item of size 0 has one empty piece. Items are dealt to blocks by hash, about
    ``windows`` containers each (more blocks if items are very small), and every block is packed by itself, so no task grows with the
    data; each block leaves less than one container of space on average. Equal identifiers are
    separate items. An empty table gives no rows.
    """
    kind = items.schema[id_col].dataType
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(id_col).alias("id"), size.alias("n"))
    n_items, total = rows.agg(F.count(F.lit(1)), F.sum(F.pmod("n", F.lit(capacity)))).first()
    blocks = max(1, round((total or 0) / capacity / windows), n_items // ITEMS)
    block = F.pmod(F.xxhash64("id", "n"), F.lit(blocks))
    full = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(F.lit(0)).cast("bigint")
    parts = rows.select("id", "n", block.alias("block"), full.alias("full"))
    whole = parts.filter("full > 0").select("id", "block", "n", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select("id", F.col("piece").cast("int"), (F.col("piece") * capacity).cast("bigint").alias("start"), F.lit(capacity).cast("bigint").alias("size"), F.concat(F.lit("full-"), F.xxhash64("id", "n").cast("string"), F.lit("-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    rest = parts.select("id", "block", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).cast("bigint").alias("start"), (F.col("n") - F.col("full") * capacity).cast("bigint").alias("size")).filter("size > 0 or start = 0")
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("container", T.StringType())])

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        slot = fill_block(pdf["size"].to_numpy(dtype=np.int64), capacity)
        pdf["container"] = [f"{int(key[0]):06d}-{k}" for k in slot]
        return pdf[["id", "piece", "start", "size", "container"]]

    # a fixed number of partitions: small shuffles are not merged into one task, whose work is not in its bytes
    spread = rest.repartition(tasks(blocks, width(items.sparkSession)), "block")
    return whole.unionByName(spread.groupBy("block").applyInPandas(fill, schema))


def pack_documents(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """:func:`pack` of documents by their number of tokens; the counts are made once and written."""
    from .encode import count_tokens

    return pack(materialise(count_tokens(df, id_col, text_col), "sizes"), "id", "n_tokens", capacity)
