"""Reachability and rolls without bounds: rounds on a long chain, cycles, and a roll over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import vectors as V


def test_a_long_chain_takes_few_rounds(spark, monkeypatch, capsys):
    """1,000 hops: 8 one by one, then doubling; before, each hop wrote two checkpoints, about 2,000 in all."""
    cuts = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, cut=G.cut_lineage: cuts.append(1) or cut(df))
    chain = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = G.reachable(chain, spark.createDataFrame([(0,), (600,)], "node long"))
    rows = {(r.start, r.node): r.hops for r in got.collect()}
    assert rows == {(a, b): b - a for a in (0, 600) for b in range(a + 1, 1001)}
    with capsys.disabled():
        print(f" chain of 1,000 hops: {len(cuts)} checkpoints", end="")
    assert len(cuts) < 45


def test_random_graphs_with_cycles(spark, monkeypatch):
    monkeypatch.setattr(G, "FRONTIER", 2)
    rng = random.Random(5)
    edges = {(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)} | {(i, i + 1) for i in range(40, 60)} | {(60, 40), (7, 7)}
    want = {}
    for start in (0, 3, 7, 40, 55, 99):
        level, seen, hops = {start}, {start}, 0
        while level:
            level, hops = {b for a, b in edges if a in level} - seen, hops + 1
            want |= {(start, b): hops for b in level}
            seen |= level
    starts = spark.createDataFrame([(n,) for n in (0, 3, 7, 40, 55, 99, 99)], "node long")
    got = G.reachable(spark.createDataFrame(sorted(edges), "src long, dst long"), starts)
    assert {(r.start, r.node): r.hops for r in got.collect()} == want
    assert G.reachable(spark.createDataFrame([], "src long, dst long"), starts).count() == 0


@pytest.mark.parametrize("n", [1, 2, 57])
def test_roll_over_all_rows(spark, n):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(0, 2 * n, 2)], "k long, embedding array<double>, label int").repartition(3)
    got = {r.k: (r.partner[0], r["other"], r["__n"]) for r in V.rolled(df, "k", {"embedding": "partner", "label": "other"}).collect()}
    assert got == {2 * i: (float(2 * ((i - 1) % n)), 2 * ((i - 1) % n) % 3, n) for i in range(n)}
    m = V.mixup(df, "k", 0.5, 3)
    assert m.count() == n and all(abs(sum(r.targets) - 1) < 1e-9 for r in m.collect())


def test_pairs_are_written_once(spark, monkeypatch):
    """What rounds leave holds each pair once, however many rounds there are; steps and jumps are gone, shuffle files too."""
    folders = []
    monkeypatch.setattr(G, "Rounds", lambda s, made=G.Rounds: folders.append(made(s)) or folders[-1])
    chains = spark.range(40 * 30).where("id % 40 < 39").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = G.reachable(chains, spark.range(40 * 30).select(F.col("id").alias("node")))
    assert got.count() == 30 * 40 * 39 // 2 == got.distinct().count()
    path = spark._jvm.org.apache.hadoop.fs.Path(folders[0].folder)
    left = [f.getPath() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    assert not [f for f in left if f.getName() == "steps" or f.getName().startswith("jump")]
    assert spark.read.parquet(*(f.toString() for f in left)).count() == got.count() + 40 * 30
