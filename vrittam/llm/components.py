"""Connected components of an edge table: union-find by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hotkeys import hot_keys, join_hot
from ..scratch import drop, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``u``, ``v``.

    The minimum of a node's neighbourhood comes from an aggregation (partial on the map side), is
    written with the exact number of neighbours and joined back; the edges of a node with very many
    neighbours are spread over tasks by a salt.
    """
    if large:
        edges = edges.union(edges.select("v", "u"))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
    hot = hot_keys(low, ["u"])
    if large:
        least = low.select("u", F.least("u", "m").alias("m"))
        out = join_hot(edges.filter("v > u"), least, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = join_hot(edges, low.select("u", "m"), ["u"], hot)
        out = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = materialise(out.distinct(), "edges")
    drop(low)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (smallest id of the component) of every node of ``src``, ``dst``.

    Self-loops keep a lone node as its own component; null ends are dropped; an empty table gives
    no rows. The number of rounds grows with the logarithm of the longest path; each round's edges
    are written to the shared folder, so no lineage builds up and no task holds a component.
    """
    e = edges.filter("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    nodes = materialise(e.select("u").union(e.select("v")).distinct(), "nodes")
    now = materialise(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        half = _star(now, large=True)
        nxt = _star(half, large=False)
        drop(now, half)
        now = nxt
        # star forest reached: every node has one edge, and it leads to a node without one
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast(T.DecimalType(38, 0)))).first()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return nodes.join(now.toDF("u", "v"), "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))
