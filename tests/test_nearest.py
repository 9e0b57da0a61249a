"""The inverted file against brute force: ties, classes, zero and broken vectors, many concepts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import nearest as N


def brute(q, c, k, by=False):
    out = {}
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    for i, kind, v in q:
        scores = sorted((-round(float(unit(v) @ unit(w)), 12), label) for label, other, w in c if not by or other == kind)
        for rank, (score, label) in enumerate(scores[:k], 1):
            out[i, rank] = (label, round(-score, 9))
    return out


def found(df):
    return {(r["query_id"], r["rank"]): (r["label"], round(r["score"], 9)) for r in df.collect()}


def frames(spark, q, c):
    of = lambda rows, name: spark.createDataFrame([(i, kind, [float(x) for x in v]) for i, kind, v in rows], f"{name} long, kind string, embedding array<double>")
    return of(q, "query_id"), of(c, "label")


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    c = [(i, "ab"[i % 2], centres[i % 12] + rng.normal(size=8) * 0.3) for i in range(600)]
    c += [(1000 + i, "a", c[i][2]) for i in range(40)]  # ties
    c += [(2000, "a", np.zeros(8)), (2001, "lonely", rng.normal(size=8))]
    q = [(i, "ab"[i % 2], centres[i % 12] + rng.normal(size=8)) for i in range(90)] + [(200, "a", np.zeros(8)), (201, "lonely", rng.normal(size=8))]
    return q, c


@pytest.mark.parametrize(("k", "by"), [(1, False), (3, True), (7, False)])
def test_brute_force(spark, clustered, monkeypatch, k, by):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "CHUNK", 9)
    q, c = clustered
    qs, cs = frames(spark, q, c)
    assert found(N.nearest(qs, cs, k, "kind" if by else None, pivots=20)) == brute(q, c, k, by)


def test_classes_that_share_cells(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "MAX_CELLS", 2)
    monkeypatch.setattr(N, "BLOCK", 50)
    q, c = clustered
    assert found(N.nearest(*frames(spark, q, c), 3, "kind", pivots=20)) == brute(q, c, 3, True)


def test_more_asked_than_there_are(spark):
    q, c = [(1, "a", [1, 0])], [(5, "a", [1, 0]), (4, "a", [1, 0]), (9, "a", [0, 1])]
    assert found(N.nearest(*frames(spark, q, c), 9)) == brute([(1, "a", np.array([1, 0]))], [(i, k, np.array(v)) for i, k, v in c], 9)


def test_broken_vectors_and_empty_tables(spark):
    schema = "query_id long, embedding array<float>"
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, []), (5, [1.0])], schema)
    c = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [None, 1.0])], "label long, embedding array<float>")
    assert found(N.nearest(q, c, 2)) == {(1, 1): (7, 1.0)}
    assert N.nearest(q.where("false"), c).count() == 0
    assert N.nearest(q, c.where("false")).columns == ["query_id", "label", "score", "rank"]


def test_far_cells_are_not_met(spark, clustered, monkeypatch):
    """What the bound rules out saves pairs, and no group has all queries."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "CHUNK", 9)
    met = []
    monkeypatch.setattr(N, "cut_lineage", lambda df, cut=N.cut_lineage: met.append(cut(df)) or met[-1])
    q, c = clustered
    qs, cs = frames(spark, q, c)
    N.nearest(qs, cs, 1, pivots=12).collect()
    pairs = sum(df.count() for df in met if "cell" in df.columns and "query_id" in df.columns)
    assert pairs < 0.6 * len(q) * 12


def test_two_hundred_thousand_concepts(spark):
    n, dim = 200_001, 8
    rng = np.random.default_rng(1)
    q = rng.normal(size=(20, dim))
    vector = F.array(*(F.sin(F.col("id") * (0.37 + i) + i * i).alias(f"x{i}") for i in range(dim)))
    c = spark.range(n).select(F.col("id").alias("label"), vector.alias("embedding"))
    got = found(N.nearest(spark.createDataFrame(pd.DataFrame({"query_id": range(20), "embedding": list(q.tolist())})), c, 2))
    ids = np.arange(n)[:, None]
    all_ = np.sin(ids * (0.37 + np.arange(dim)) + np.arange(dim) ** 2)
    all_ /= np.linalg.norm(all_, axis=1, keepdims=True)
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ all_.T, 12)
    for i in range(20):
        order = np.lexsort((np.arange(n), -scores[i]))[:2]
        assert [got[i, r][0] for r in (1, 2)] == order.tolist()
