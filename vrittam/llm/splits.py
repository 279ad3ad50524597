"""Splits that keep related records together.

Records that quote a common couplet, directly or through others, form a component. Components are
shared out over blocks of bounded size; in each block a swap search starts from hashed splits and
moves or exchanges whole components by simulated annealing, in several chains at once, against
the deviation of sizes and of label counts; the best chain of each block is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .couplets import quoted_couplets
from .packing import tasks
from ..scratch import materialise, width
from .components import connected_components
from ..operators.hotkeys import hot_keys, join_hot

SPLITS = ("train", "val", "test")
SHARES = (0.8, 0.1, 0.1)
#: Components of a block, chains per block, steps per component, and records from which a component is placed ahead of the blocks.
BLOCK, CHAINS, STEPS, LARGE = 4000, 4, 6, 20_000
#: Components placed ahead, at most: beyond so many the size from which one is placed ahead rises with the table.
MOST_LARGE = 10_000


def _digests(extract: Callable[[str | None], list[str]]):
    import hashlib

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted({hashlib.blake2b(q.encode(), digest_size=16).digest() for q in extract(x)}))

    return keys


def components_of(df: DataFrame, id_col: str, text_col: str, extract: Callable[[str | None], list[str]] = quoted_couplets) -> DataFrame:
    """``id``, ``component`` of every record: the smallest identifier it is linked with by common quotes.

    A record without a quote (null, blank or plain text) is its own component. Only couplets that
    one record quotes together are edges of the graph; the records themselves are attached by one
    join, whose hot couplets are spread.
    """
    rows = materialise(df.select(F.col(id_col).alias("id"), _digests(extract)(F.col(text_col)).alias("keys")), "quotes")
    quotes = rows.select("id", F.explode("keys").alias("key"))
    firsts = materialise(quotes.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    hot = hot_keys(firsts, ["key"])
    seen = materialise(join_hot(quotes, firsts.select("key", "first"), ["key"], hot).select("id", "first"), "seen")
    # records with several quotes link the first records of those
    several = rows.filter(F.size("keys") > 1).select("id")
    edges = seen.join(several, "id", "left_semi").groupBy("id").agg(F.min("first").alias("low"), F.collect_set("first").alias("all"))
    edges = edges.select(F.explode("all").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()
    roots = connected_components(edges).toDF("first", "root")
    of = seen.groupBy("id").agg(F.min("first").alias("first")).join(roots, "first", "left").select("id", F.coalesce("root", "first").alias("component"))
    return rows.select("id").join(of, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _anneal(sizes: np.ndarray, labels: np.ndarray, target: np.ndarray, start: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """Move or exchange components between splits; returns the best assignment met and its cost.

    ``labels`` holds the records of each component by label. The cost is the sum of squared
    deviations of split sizes and, at a tenth of the weight, of the label counts of each split.
    """
    rng = np.random.default_rng(seed)
    k = len(target)
    now = start.copy()
    total = sizes.sum()
    goal = np.outer(target, labels.sum(axis=0) / max(total, 1))
    load = np.array([sizes[now == s].sum() for s in range(k)], dtype=float) - target
    have = np.array([labels[now == s].sum(axis=0) for s in range(k)], dtype=float).reshape(k, -1) - goal

    def cost(a: np.ndarray, b: np.ndarray) -> float:
        return float((a * a).sum() + 0.1 * (b * b).sum())

    value = cost(load, have)
    best, best_value = now.copy(), value
    heat = max(value / 10, 1.0)
    n = len(sizes)
    one, other, to, coin, swap = rng.integers(n, size=steps), rng.integers(n, size=steps), rng.integers(k, size=steps), rng.random(steps), rng.random(steps) < 0.5
    for t in range(steps):
        i, j = one[t], other[t]
        a, b = now[i], now[j] if swap[t] else to[t]
        if a == b:
            continue
        ds, dl = float(sizes[i]), labels[i]
        if swap[t]:
            ds, dl = ds - sizes[j], dl - labels[j]
        change = 2 * ds * (load[b] - load[a] + ds) + 0.2 * float((dl * (have[b] - have[a] + dl)).sum())
        if change <= 0 or coin[t] < np.exp(-change / heat):
            now[i] = b
            if swap[t]:
                now[j] = a
            load[a] -= ds
            load[b] += ds
            have[a] -= dl
            have[b] += dl
            value += change
            if value < best_value - 1e-9:
                best, best_value = now.copy(), value
        heat = max(heat * (1 - 4 / steps), 1e-3)
    return best, best_value


def _place_large(large: list[tuple], total: int, shares: tuple[float, ...]) -> tuple[dict, list[float]]:
    """Splits of the few components of :data:`LARGE` or more records, largest first into the emptiest split by share; and what is left of the splits."""
    left = [s * total for s in shares]
    where = {}
    for comp, n in sorted(large, key=lambda x: (-x[1], str(x[0]))):
        k = max(range(len(shares)), key=lambda s: left[s])
        where[comp] = k
        left[k] -= n
    return where, left


def grouped_splits(df: DataFrame, id_col: str, text_col: str, label_col: str, shares: tuple[float, ...] = SHARES, names: tuple[str, ...] = SPLITS, seed: int = 7, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """``id``, ``component``, ``split``: splits of the given shares in which no component is divided.

    Labels (null counts as one of its own) keep about the same shares in each split. Components of
    ``large`` or more records, at most :data:`MOST_LARGE` of them, are placed first and the others
    fill up what they leave. The result depends on the data and ``seed`` only. An empty table
    gives no rows; a single component lands whole in one split.
    """
    label = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"))
    comps = materialise(components_of(df, id_col, text_col), "components")
    counts = comps.join(label, "id").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("component").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"))
    stats = materialise(stats, "sizes")
    total, most = stats.agg(F.sum("size"), F.max("size")).first()
    total = int(total or 0)
    large = max(large, total // MOST_LARGE)
    big = [(r[0], int(r[1])) for r in stats.filter(F.col("size") >= large).select("component", "size").collect()] if (most or 0) >= large else []
    fixed, left = _place_large(big, total, shares)
    left = [max(x, 0.0) for x in left]
    share = np.array([x / sum(left) for x in left]) if sum(left) else np.array(shares)
    n_small = max(stats.count() - len(big), 0)
    blocks = max(1, -(-n_small // block))
    # the hashed start: a uniform number of each component, and its block
    u = (F.shiftrightunsigned(F.xxhash64("component", F.lit(seed + 1)), 11) / F.lit(2.0**53)).alias("u")
    small = stats.filter(F.col("size") < large).withColumn("block", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(blocks)))
    kind = stats.schema["component"].dataType

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", kind="stable").reset_index(drop=True)
        sizes = pdf["size"].to_numpy(dtype=float)
        maps = [dict(m) for m in pdf["labels"]]
        kinds = {v: i for i, v in enumerate(sorted({v for m in maps for v in m}))}
        labels = np.zeros((len(pdf), len(kinds)))
        for i, m in enumerate(maps):
            for v, n in m.items():
                labels[i, kinds[v]] = n
        start = np.minimum(np.searchsorted(np.cumsum(share), pdf["u"].to_numpy(), side="right"), len(share) - 1)
        tried = [_anneal(sizes, labels, share * sizes.sum(), start, STEPS * len(pdf) + 200, seed * 1000 + chain) for chain in range(CHAINS)]
        got, _ = min(tried, key=lambda x: x[1])
        return pd.DataFrame({"component": pdf["component"], "k": got.astype("int32")})

    schema = T.StructType([T.StructField("component", kind), T.StructField("k", T.IntegerType())])
    dealt = small.select("component", "size", "labels", "block", u).repartition(tasks(blocks, width(df.sparkSession)), "block")
    chosen = materialise(dealt.groupBy("block").applyInPandas(search, schema), "chosen")
    if fixed:
        spark = df.sparkSession
        chosen = chosen.unionByName(spark.createDataFrame(list(fixed.items()), T.StructType([T.StructField("component", kind), T.StructField("k", T.IntegerType())])))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    hot = hot_keys(stats, ["component"], "size")
    return join_hot(comps, chosen, ["component"], hot).select("id", "component", name.alias("split"))


def linked_records(df: DataFrame, id_col: str, text_col: str, label_col: str, **options) -> DataFrame:
    """``first_id``, ``id`` of every record that :func:`grouped_splits` puts in one split with a record of smaller identifier because they belong together."""
    out = grouped_splits(df, id_col, text_col, label_col, **options)
    return out.filter(F.col("component") < F.col("id")).filter("split is not null").select(F.col("component").alias("first_id"), "id")
