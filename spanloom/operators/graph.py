"""Concept graphs as node and edge tables: neighbours, closures, neighbourhoods, shortest paths by frontiers.

Edges have src, dst, type and optionally group. Loops carry (start, node) pairs, so that many starts run at once; each round is
written in the shared folder. No loop has a bound but that nothing new is found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut_lineage, shared_path

# Type of Is-A, the root concept, fully specified names and synonyms.
IS_A, ROOT, FSN, SYNONYM = 116680003, 138875005, 900000000000003001, 900000000000013009
#: Hops that are taken one by one before jumps double.
FRONTIER = 8
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def from_tables(descriptions: DataFrame, relationships: DataFrame, collapse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from active rows. nodes: sctid, fsn (else the first synonym), synonyms; only concepts on an edge.

    descriptions: conceptId, term, typeId, active, ord; relationships: sourceId, destinationId, typeId, relationshipGroup,
    active, ord. collapse keeps one edge per pair, the last one, as a graph without parallel edges would.
    """
    d = descriptions.where("active = 1")
    names = d.groupBy(F.col("conceptId").alias("sctid")).agg(F.min_by("term", F.when(F.col("typeId") == FSN, F.col("ord"))).alias("f"), F.array_sort(F.collect_list(F.when(F.col("typeId") == SYNONYM, F.struct("ord", "term")))).alias("s"))
    nodes = names.select("sctid", F.coalesce("f", F.get("s", F.lit(0))["term"]).alias("fsn"), F.transform("s", lambda x: x["term"]).alias("synonyms"))
    edges = relationships.where("active = 1").select(F.col("sourceId").alias("src"), F.col("destinationId").alias("dst"), F.col("relationshipGroup").alias("group"), F.col("typeId").alias("type"), "ord")
    if collapse:
        edges = edges.groupBy("src", "dst").agg(F.max_by(F.struct("group", "type", "ord"), "ord").alias("x")).select("src", "dst", "x.*")
    ends = edges.select(F.col("src").alias("sctid")).unionByName(edges.select(F.col("dst").alias("sctid"))).distinct()
    return nodes.join(ends, "sctid", "left_semi"), edges


def parents(edges: DataFrame, is_a=IS_A) -> DataFrame:
    """src, dst of Is-A edges: dst is a parent of src."""
    return edges.where(F.col("type") == is_a).select("src", "dst").distinct()


def children(edges: DataFrame, is_a=IS_A) -> DataFrame:
    """src, dst turned round: dst is a child of src."""
    return parents(edges, is_a).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def relation_groups(edges: DataFrame, is_a=IS_A) -> DataFrame:
    """src, group, relations (type, dst) of edges other than Is-A."""
    return edges.where(F.col("type") != is_a).groupBy("src", "group").agg(F.array_sort(F.collect_set(F.struct("type", "dst"))).alias("relations"))


def relationship_types(edges: DataFrame) -> DataFrame:
    return edges.select("type").distinct()


def concept_details(nodes: DataFrame, edges: DataFrame, ids: DataFrame, is_a=IS_A) -> DataFrame:
    """sctid, fsn, synonyms, parents, children of the given ids (column sctid)."""
    up = parents(edges, is_a).groupBy(F.col("src").alias("sctid")).agg(F.array_sort(F.collect_set("dst")).alias("parents"))
    down = children(edges, is_a).groupBy(F.col("src").alias("sctid")).agg(F.array_sort(F.collect_set("dst")).alias("children"))
    return nodes.join(ids.select("sctid").distinct(), "sctid", "left_semi").join(up, "sctid", "left").join(down, "sctid", "left")


def reachable(steps: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node, hops: what can be reached from each start along (src, dst), with the fewest hops; a start isn't its own
    result, even on a cycle. depth bounds the hops and must be positive; without it everything reachable is found.

    Up to FRONTIER hops go one by one. What lies farther is found by jumps that double: after n rounds of them a jump covers
    up to 2 ** n hops, so a chain of h hops takes about log2(h) rounds.

    A pair is written once, as Parquet, in the round that finds it, and led on in the next one alone. The tables of pairs stay, as
    the result reads them; steps and jumps are removed.
    """
    if depth is not None and depth <= 0:
        raise ValueError("steps must be positive")
    rounds = Rounds(steps.sparkSession)
    steps = rounds.put("steps", steps.select("src", "dst").distinct())
    seen = front = rounds.put("hop0", starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0)))
    hops = ["hop0"]
    for hop in range(1, (depth or FRONTIER) + 1):
        ahead = front.join(steps.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).distinct()
        hops.append(f"hop{hop}")
        front = rounds.put(hops[-1], ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = rounds.get(*hops)
        if front.isEmpty():
            depth = hop
            break
    if depth is None:
        return _doubled(rounds, steps, hops).where("hops > 0")
    rounds.drop("steps")
    return seen.where("hops > 0")


class Rounds:
    """Tables that rounds write in a folder of their own in the shared one. A round's shuffle files go as soon as it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_path(spark)}/rounds-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(SHUFFLE_CLEANUP)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.get(name)

    def get(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{n}" for n in names))

    def drop(self, *names: str) -> None:
        for n in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _doubled(rounds: Rounds, steps: DataFrame, hops: list[str]) -> DataFrame:
    """The pairs of the tables `hops` (start, node, hops), complete up to len(hops) - 1 hops, with all that lies farther.

    A jump is a pair of nodes at most `reach` hops apart. A shortest path longer than `at` hops passes a node at exactly `at`, so
    jumps from there give all pairs up to at + reach; if none is that far, nothing lies beyond. Jumps double in the same way.
    """
    at, reach, n, farther = len(hops) - 1, 1, 0, ["jump0"]
    jumps = rounds.put("jump0", steps.where("src <> dst").withColumn("hops", F.lit(1)))
    seen = rounds.get(*hops)
    fewest = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("hops").alias("hops"))
    while True:
        n += 1
        ahead = seen.where(F.col("hops") == at).join(jumps.select(F.col("src").alias("node"), "dst", F.col("hops").alias("more")), "node")
        far = fewest(ahead.select("start", F.col("dst").alias("node"), (F.col("hops") + F.col("more")).alias("hops")), "start", "node")
        hops.append(f"far{n}")
        front = rounds.put(hops[-1], far.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen, at = rounds.get(*hops), at + reach
        if front.where(F.col("hops") == at).isEmpty():
            rounds.drop("steps", *farther)
            return seen
        ahead = jumps.where(F.col("hops") == reach).join(jumps.select(F.col("src").alias("dst"), F.col("dst").alias("goal"), F.col("hops").alias("more")), "dst")
        twice = fewest(ahead.where("src <> goal").select("src", F.col("goal").alias("dst"), (F.col("hops") + F.col("more")).alias("hops")), "src", "dst")
        farther.append(f"jump{n}")
        rounds.put(farther[-1], twice.join(jumps.select("src", "dst"), ["src", "dst"], "left_anti"))
        jumps, reach = rounds.get(*farther), reach * 2


def descendants(edges: DataFrame, starts: DataFrame, depth: int | None = None, is_a=IS_A) -> DataFrame:
    return reachable(children(edges, is_a), starts, depth)


def ancestors(edges: DataFrame, starts: DataFrame, depth: int | None = None, is_a=IS_A, root=ROOT) -> DataFrame:
    """Like descendants(), upwards, without the root."""
    return reachable(parents(edges, is_a), starts, depth).where(F.col("node") != root)


def neighbourhood(edges: DataFrame, starts: DataFrame, steps: int = 1, is_a=IS_A, root=ROOT) -> DataFrame:
    """Concepts within so many Is-A steps in either direction; the root is left out of the result alone."""
    return reachable(parents(edges, is_a).unionByName(children(edges, is_a)).distinct(), starts, steps).where(F.col("node") != root)


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """One row, path (array of ids): the shortest directed path over all types from start to goal, else from goal to start,
    with the smallest ids among equally short ones; no row without a path."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst").distinct()
    for a, b in ((start, goal), (goal, start)):
        front = seen = cut_lineage(spark.range(1).select(F.lit(a).cast("bigint").alias("node"), F.array(F.lit(a).cast("bigint")).alias("path")))
        while True:
            found = front.where(F.col("node") == b).select("path")
            if not found.isEmpty():
                return found
            ahead = front.join(steps.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
            ahead = ahead.groupBy("node").agg(F.min("path").alias("path"))
            front = cut_lineage(ahead.join(seen, "node", "left_anti"))
            if front.isEmpty():
                break
            seen = cut_lineage(seen.select("node", "path").unionByName(front))
    return seen.where(F.lit(False)).select("path")


def class_synonyms(nodes: DataFrame, edges: DataFrame, root: int, extra: list[tuple[int, list[str]]] = (), is_a=IS_A) -> DataFrame:
    """sctid, synonyms of all concepts below a class root, and literal extra entries."""
    below = descendants(edges, edges.sparkSession.range(1).select(F.lit(root).cast("bigint").alias("node")), is_a=is_a)
    found = nodes.join(below.select(F.col("node").alias("sctid")), "sctid", "left_semi").select("sctid", "synonyms")
    return found.unionByName(edges.sparkSession.createDataFrame(list(extra), found.schema)) if extra else found
