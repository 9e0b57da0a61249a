"""Queries of graphs: parts form a tree by number, suppliers and customers hang below nations and regions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from . import inputs as I
from .registry import query

_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 10 AS dst FROM part WHERE p_partkey // 10 > 0)"


def _edges(spark, sf_dir):
    p = I.table(spark, sf_dir, "part").withColumn("dst", F.floor(F.col("p_partkey") / 10).cast("bigint"))
    return p.where("dst > 0").select(F.col("p_partkey").cast("bigint").alias("src"), "dst", F.lit(G.IS_A).alias("type"), F.lit(0).alias("group"))


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


@query("descendants", _TREE + ", r(start, node, hops) AS (SELECT dst, src, 1 FROM e WHERE dst IN (1, 7, 12) UNION ALL SELECT r.start, e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.node) SELECT start, node, hops FROM r")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendants(_edges(spark, sf_dir), _starts(spark, 1, 7, 12))


@query("ancestors", _TREE + ", r(start, node, hops) AS (SELECT src, dst, 1 FROM e WHERE src IN (115, 19, 101) UNION ALL SELECT r.start, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node) SELECT start, node, hops FROM r WHERE node <> 1")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(_edges(spark, sf_dir), _starts(spark, 115, 19, 101), root=1)


@query("neighbourhood", _TREE + ", b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(start, node, hops) AS (SELECT src, dst, 1 FROM b WHERE src IN (11, 5) UNION ALL SELECT r.start, b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.node WHERE r.hops < 2) SELECT start, node, min(hops) AS hops FROM r WHERE node <> start AND node <> 1 GROUP BY start, node")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(_edges(spark, sf_dir), _starts(spark, 11, 5), 2, root=1)


@query("shortest_path", _TREE + ", r(node, path) AS (SELECT 115::BIGINT, '115' UNION ALL SELECT e.dst, path || '>' || e.dst FROM r JOIN e ON e.src = r.node) SELECT path FROM r WHERE node = 1")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(_edges(spark, sf_dir), 1, 115).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("relation_groups", "SELECT l_suppkey AS src, l_linenumber AS \"group\", array_to_string(list_sort(list(DISTINCT l_partkey)), '|') AS targets FROM lineitem GROUP BY ALL")
def relation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("group"), F.lit(1).alias("type"))
    return G.relation_groups(e).select("src", "group", F.concat_ws("|", F.transform("relations", lambda r: r["dst"].cast("string"))).alias("targets"))


@query("concept_details", "SELECT n_nationkey AS sctid, n_name AS fsn, n_regionkey AS parent, count(s_suppkey) AS n_children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def concept_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = I.table(spark, sf_dir, "nation"), I.table(spark, sf_dir, "supplier")
    up = n.select((F.col("n_nationkey") + 1000).alias("src"), F.col("n_regionkey").alias("dst"), F.lit(G.IS_A).alias("type"))
    down = s.select((F.col("s_suppkey") + 100000).alias("src"), (F.col("s_nationkey") + 1000).alias("dst"), F.lit(G.IS_A).alias("type"))
    nodes = n.select((F.col("n_nationkey") + 1000).alias("sctid"), F.col("n_name").alias("fsn"))
    d = G.concept_details(nodes, up.unionByName(down), nodes.select("sctid"))
    return d.select((F.col("sctid") - 1000).alias("sctid"), "fsn", F.get("parents", F.lit(0)).alias("parent"), F.coalesce(F.size("children"), F.lit(0)).cast("bigint").alias("n_children")).withColumn("n_children", F.greatest("n_children", F.lit(0)))


_STEPS = """WITH RECURSIVE e AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) JOIN part b ON b.p_partkey = a.p_partkey + k),
reach(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM reach JOIN e ON e.src = node WHERE hops < 11),
dist AS (SELECT node, min(hops) AS d FROM reach GROUP BY node),
short AS (SELECT e.src, e.dst FROM e JOIN dist x ON x.node = e.src JOIN dist y ON y.node = e.dst AND y.d = x.d + 1),
walk(node, path) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT s.dst, list_append(path, s.dst) FROM walk JOIN short s ON s.src = node WHERE s.dst <= 30)
"""


@query("shortest_path_ties", _STEPS + "SELECT array_to_string(min(path), '>') AS path FROM walk WHERE node = 30")
def shortest_path_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equally short paths from part 1 to part 30 by steps of one to three: the one with the smallest numbers."""
    p = I.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("src"))
    edges = p.select("src", F.explode(F.array(*(F.col("src") + k for k in (1, 2, 3)))).alias("dst")).join(p.select(F.col("src").alias("dst")), "dst")
    return G.shortest_path(edges, 1, 30).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
