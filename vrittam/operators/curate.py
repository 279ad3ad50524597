"""Corpus curation: lookups, deduplication, samples, splits, profiles, training formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups that a stratified sample may have; their quotas are made on the driver.
MOST_GROUPS = 100_000


def hashed(seed: int, *ids: Column) -> Column:
    """Order of a seeded shuffle: the same in any engine that knows MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in ids]))


def lookup_last(build: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key`` to the ``value`` of its last row by ``order``; one partial aggregation instead of a window."""
    return build.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key by ``order``; rows of a null key are all kept.

    An aggregation of whole rows, so a key with very many rows is merged partially before it moves.
    """
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    kept = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return kept.unionByName(df.filter(F.col(key).isNull()).select(row.alias("r")).select("r.*").select(*df.columns))


def quotas(counts: dict, total: int) -> dict:
    """Water filling: equal shares of ``total`` over the groups, none beyond its size, what is left goes on to the others.

    Larger remainders go to the groups that come first in order of their names.
    """
    left, out, open_ = total, dict.fromkeys(sorted(counts), 0), sorted(counts)
    while open_:
        share, more = divmod(left, len(open_))
        full = [g for g in open_ if counts[g] <= share]
        if not full:
            return out | {g: min(counts[g], share + (k < more)) for k, g in enumerate(open_)}
        for g in full:
            out[g] = counts[g]
            left -= counts[g]
            open_.remove(g)
    return out


def stratified(df: DataFrame, group: str, id_col: str, total: int, seed: int) -> DataFrame:
    """Sample of ``total`` rows, as equal over the groups as their sizes allow.

    The group sizes are counted first; more than :data:`MOST_GROUPS` groups are refused. A hash threshold generous enough for each quota thins
    the rows before they are ranked, so a group is never sorted whole.
    """
    counts = {r[0]: r[1] for r in df.groupBy(group).count().limit(MOST_GROUPS + 2).collect() if r[0] is not None}
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    want = quotas(counts, total)
    spark = df.sparkSession
    q = F.broadcast(spark.createDataFrame([(g, n, counts[g]) for g, n in want.items()], f"{group} string, _quota bigint, _size bigint"))
    u = F.conv(F.substring(hashed(seed, F.col(id_col)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    thin = F.col("_quota") / F.col("_size")
    kept = df.join(q, group).filter(u <= thin + 4 * F.sqrt(thin / F.col("_size")) + 16 / F.col("_size"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hashed(seed, F.col(id_col)), id_col))
    return kept.withColumn("_rank", rank).filter("_rank <= _quota").drop("_rank", "_quota", "_size")


def exact_splits(df: DataFrame, id_col: str, seed: int, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """``id_col``, ``split`` with exact sizes: the first tenth of a seeded order is test, the next val, the rest train.

    The two borders are order statistics of the hashes, found by exact percentiles of a numeric key
    with counts, not by ranking all rows in one task.
    """
    h = df.select(F.col(id_col), hashed(seed, F.col(id_col)).alias("h"))
    n = h.count()
    n_test, n_val = max(1, int(n * test)) if n else 0, max(1, int(n * val)) if n else 0
    borders = [_nth(h, k) for k in (n_test, n_test + n_val)]
    split = F.lit("train")
    for border, name in zip(reversed(borders), ("val", "test")):
        if border is not None:
            split = F.when((F.col("h") < border[0]) | ((F.col("h") == border[0]) & (F.col(id_col) <= border[1])), name).otherwise(split)
    return h.select(id_col, split.alias("split"))


def _nth(h: DataFrame, k: int):
    """(hash, id) of rank ``k``: the bucket of four hex digits that holds it is found by counts, then only that bucket is sorted."""
    if k < 1:
        return None
    id_col = h.columns[0]
    buckets = sorted((r[0], r[1]) for r in h.groupBy(F.substring("h", 1, 3).alias("b")).count().collect())
    for b, n in buckets:
        if k <= n:
            return h.filter(F.substring("h", 1, 3) == b).orderBy("h", id_col).limit(k).orderBy(F.desc("h"), F.desc(id_col)).select("h", id_col).first()
        k -= n
    return None


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """Name by a uniform number and weights (normalised), in the order given."""
    total, run, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        run += w / total
        cond = u < run
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(list(weights)[-1])


def alpaca(instruction: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), F.lit("").alias("input"), output.alias("output"))


def sharegpt(instruction: Column, output: Column) -> Column:
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.struct(F.array(turn("human", instruction), turn("gpt", output)).alias("conversations"))


def messages(instruction: Column, output: Column, system: str | None = None) -> Column:
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    head = [turn("system", F.lit(system))] if system else []
    return F.struct(F.array(*head, turn("user", instruction), turn("assistant", output)).alias("messages"))
