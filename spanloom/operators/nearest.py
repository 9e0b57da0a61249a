"""Nearest concepts by cosine: an inverted file of unit vectors, searched exactly by the triangle inequality.

A bounded sample of the concepts serves as pivots; every concept lies in the cell of its nearest pivot, and of each cell the
nearest and farthest distance to the pivot are known. A query first meets the nearest cells that hold k concepts. Its k-th
best distance then rules out all cells that lie farther away, whatever they hold; it meets the rest. Cells are cut into blocks
and the queries of a cell into chunks, so a task multiplies one block by one chunk, and no group has all queries or all
concepts. Only the pivots and one row a cell come to the driver and go to the tasks, both with bounds.

With vectors of many dimensions that have no structure few cells can be ruled out, and the work is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .shared import cut_lineage

#: Concepts of a block, queries of a chunk.
BLOCK, CHUNK = 4096, 4096
#: Bounds of what goes to the driver and to each task: bytes of pivots, and rows of cells.
PIVOT_BYTES, MAX_CELLS = 16 << 20, 16_384
#: Distances that differ by less count as equal when cells are ruled out, so rounding loses no tie.
SLACK = 1e-6
_FOUND = "query_id long, label long, score double"


def _units(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list array as vectors of length 1; a zero vector stays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return np.divide(flat, length, out=flat.copy(), where=length > 0)


def _packed(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors).tobytes())]).cast(pa.binary())


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _valid(df: DataFrame, columns: list) -> DataFrame:
    """Rows with a vector free of nulls, NaN and infinities; `kind` is the class as a hash, so that any type will do."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(*columns, F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))


def best_of(scores: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores (to 12 digits), ties to the smaller label; labels rise."""
    rounded = np.round(scores, 12)
    if k == 1:
        return np.arange(len(scores)), rounded.argmax(axis=1)
    least = np.partition(rounded, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -np.inf)
    row, col = np.nonzero(rounded >= least[:, None])
    order = np.lexsort((col, -rounded[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def _meet(k: int):
    """The best k of one block for each query of one chunk."""

    def meet(queries: pd.DataFrame, concepts: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or concepts.empty:
            return pd.DataFrame({"query_id": [], "label": [], "score": []})
        parts, of = [], dict(list(concepts.sort_values("label").groupby("kind")))
        for kind, asked in queries.groupby("kind"):
            if kind in of:
                labels, scores = of[kind]["label"].to_numpy(), _unpacked(asked["v"]) @ _unpacked(of[kind]["v"]).T
                row, col = best_of(scores, labels, k)
                parts.append(pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "label": labels[col], "score": scores[row, col]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "label": [], "score": []})

    return meet


class _Cells:
    """The pivots, and of each (class, cell) its number of concepts and blocks and its range of distances."""

    def __init__(self, pivots: np.ndarray, rows: pd.DataFrame):
        self.pivots = pivots
        self.of = {c: g.sort_values("cell").reset_index(drop=True) for c, g in rows.groupby("c")}
        self.several = any(len(g) > 1 for g in self.of.values())

    def probes(self, c: int, vectors: np.ndarray, k: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The class' cells, the queries' distances to their pivots, and which cells each query meets first."""
        cells = self.of[c]
        far = _distances(vectors, self.pivots[cells["cell"].to_numpy()])
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(cells["n"].to_numpy()[order], axis=1) - cells["n"].to_numpy()[order]
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return cells, far, first


def _assigned(concepts: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """c, cell, kind, label, v (packed), far: each concept in the cell of its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _units(batch.column("v"))
            for at in range(0, len(vectors), BLOCK):
                far = _distances(vectors[at : at + BLOCK], pivots)
                cell, part = far.argmin(axis=1), batch.slice(at, BLOCK)
                columns = [part.column("c"), pa.array(cell.astype(np.int32)), part.column("kind"), part.column("label"), _packed(vectors[at : at + BLOCK]), pa.array(far.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "cell", "kind", "label", "v", "far"])

    return concepts.where(F.size("v") == dim).mapInArrow(run, "c long, cell int, kind long, label long, v binary, far double")


def _pairs(queries: DataFrame, cells, k: int, dim: int, later: bool) -> DataFrame:
    """query_id, kind, c, cell, v: the cells that a query meets first, or with its bound `reach` those it has to meet later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Cells = cells.value
        for batch in batches:
            classes, ids, vectors = (batch.column("c").to_numpy(), batch.column("query_id"), _units(batch.column("v")))
            reach = batch.column("reach").to_numpy(zero_copy_only=False) if later else None
            for c in np.unique(classes):
                if c not in held.of:
                    continue
                own = np.flatnonzero(classes == c)
                for at in (own[i : i + BLOCK] for i in range(0, len(own), BLOCK)):
                    rows, far, take = held.probes(c, vectors[at], k)
                    if later:
                        least = np.maximum(np.maximum(far - rows["farthest"].to_numpy(), rows["nearest"].to_numpy() - far), 0)
                        take = ~take & (least <= reach[at][:, None] + SLACK)
                    row, col = np.nonzero(take)
                    columns = [ids.take(pa.array(at[row])), batch.column("kind").take(pa.array(at[row])), pa.array(np.full(len(row), c)), pa.array(rows["cell"].to_numpy()[col].astype(np.int32)), _packed(vectors[at[row]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "kind", "c", "cell", "v"])

    return queries.where(F.size("v") == dim).mapInArrow(run, "query_id long, kind long, c long, cell int, v binary")


def _matched(pairs: DataFrame, index: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The best of each block for each query that meets its cell; sizes (c, cell, blocks) has at most MAX_CELLS rows."""
    pairs = cut_lineage(pairs)
    asked = pairs.groupBy("c", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    plan = F.broadcast(asked.join(sizes, ["c", "cell"]))
    left = pairs.join(plan, ["c", "cell"]).select("query_id", "kind", "v", "c", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"))
    right = index.join(plan, ["c", "cell"]).select("label", "kind", "v", "c", "cell", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    key = ("c", "cell", "block", "chunk")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(k), _FOUND)


def nearest(queries: DataFrame, concepts: DataFrame, k: int = 1, by: str | None = None, pivots: int | None = None) -> DataFrame:
    """query_id, label, score, rank: the k concepts with the highest cosine (to 12 digits), ties to the smaller label.

    queries: query_id, embedding; concepts: label, embedding; `by` names a class column both have, within which to search.
    Rows without a valid vector of the concepts' dimension, and queries of a class without concepts, have no result. pivots:
    how many cells to make, else as many as leave some BLOCK concepts to each.
    """
    spark = queries.sparkSession
    kind = (F.xxhash64(by) if by else F.lit(0).cast("bigint")).alias("kind")
    q = _valid(queries, [F.col("query_id").cast("bigint").alias("query_id"), kind])
    c = _valid(concepts, [F.col("label").cast("bigint").alias("label"), kind])
    n, classes, dim = c.agg(F.count("*"), F.count_distinct("kind"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    # more classes than cells share them; a task tells them apart
    shared = F.col("kind") if classes <= MAX_CELLS else F.pmod("kind", F.lit(MAX_CELLS))
    q, c, classes = q.withColumn("c", shared), c.withColumn("c", shared), min(classes, MAX_CELLS)
    wanted = pivots or max(1, n // BLOCK)
    many = max(1, min(wanted, MAX_CELLS // classes, PIVOT_BYTES // (8 * dim)))
    chosen = c.where(F.size("v") == dim).orderBy(F.xxhash64("label"), "label").limit(many).select("v").toArrow()
    held = _units(chosen.column("v").combine_chunks()) if many > 1 else np.zeros((1, dim))
    index = cut_lineage(_assigned(c, held, dim))
    stats = index.groupBy("c", "cell").agg(F.count("*").alias("n"), F.min("far").alias("nearest"), F.max("far").alias("farthest"))
    rows = stats.toPandas()  # at most MAX_CELLS
    rows["blocks"] = -(-rows["n"] // BLOCK)
    cells = spark.sparkContext.broadcast(_Cells(held, rows))
    sizes = spark.createDataFrame(rows[["c", "cell", "blocks"]].astype({"blocks": "int32"}), "c long, cell int, blocks int")
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "label")
    found = _matched(_pairs(q, cells, k, dim, False), index, sizes, k)
    if cells.value.several:
        found = cut_lineage(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        # the k-th best so far; with fewer than k all cells remain
        bound = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("had"))
        reach = F.when(F.coalesce("had", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))
        again = q.join(bound, "query_id", "left").select("query_id", "kind", "c", "v", reach.alias("reach"))
        found = found.unionByName(_matched(_pairs(again, cells, k, dim, True), index, sizes, k))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
