"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: More rounds than any graph that fits on disk needs; the rounds grow with the logarithm of the nodes.
MAX_ROUNDS = 64
#: A key is hot if it has more rows than this and than one in HOT_SHARE of all; so HOT_SHARE keys are hot at most.
HOT_ROWS, HOT_SHARE = 1 << 14, 1000
#: Edges that a task takes, and tasks at least.
TASK_ROWS, LEAST_TASKS = 100_000, 8


def join_spread(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to groups by `key`, without dealing a hot key's rows to one task.

    groups: one row per key, with the column n_rows: how many of `rows` have the key; read twice, so written before. The
    groups of hot keys, HOT_SHARE at most, are broadcast; the rest is joined by an ordinary exchange.
    """
    hot = groups.where(F.col("n_rows") > max(HOT_ROWS, total // HOT_SHARE))
    if not hot.limit(1).count():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about TASK_ROWS rows, so that rounds over few edges don't leave hundreds of tiny files each."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_rows"))
    both = join_spread(both, few(least, total).checkpoint(), "u", 2 * total) if total > HOT_ROWS else both.join(least, "u")
    return few(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    if total > HOT_ROWS:
        least = few(least, total).checkpoint()
    moved = join_spread(down, least, "u", total) if total > HOT_ROWS else down.join(least, "u")
    moved = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return few(few(moved.unionByName(least.select("u", F.col("m").alias("v"))), total).distinct(), total)


def connected_components(edges: DataFrame) -> DataFrame:
    """u, root (the smallest node of its component) for each node that has an edge and isn't a root itself.

    edges: columns u, v (long), in any order, repeats and loops allowed; null ends are left out. The minimum of a hub is
    taken by partial aggregation and broadcast to its edges. Each round is written to the shared checkpoint folder. No
    edges give an empty table. Edges that haven't settled after MAX_ROUNDS are an error; the caller gets no partial result.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    total = now.count()
    now, seen = few(now, total), None
    for _ in range(MAX_ROUNDS):
        now = few(_small_star(_large_star(now, total).checkpoint(), total).checkpoint(), total)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        seen, total = state, state[0]
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
