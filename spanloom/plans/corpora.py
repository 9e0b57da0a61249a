"""Queries of corpus reconciliation, exports and splits."""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators.shared import cut_lineage, shared_path
from ..sources import files as S
from . import inputs as I
from .registry import query


def _parts(spark, sf_dir):
    d = C.tagged(I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("report"), "text", F.col("lang").alias("type")), "documents", "train", True, "a/b")
    b = C.tagged(I.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("note_id"), F.col("text").alias("full_text")), "benchmark", "test", False, "a/c")
    return [d, b]


@query("unify_sources", "SELECT 'documents' AS dataset, 'train' AS split, true AS is_expert, 'a/b' AS hf_repo, doc_id::VARCHAR AS report, trim(coalesce(text, ''), ' ') AS full_text, coalesce(lang, '') AS doc_label FROM documents UNION ALL SELECT 'benchmark', 'test', false, 'a/c', item_id::VARCHAR, trim(text, ' '), '' FROM benchmark")
def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unify_documents(_parts(spark, sf_dir), ["text", "full_text"], ["report", "note_id"], ["doc_label", "type"])


@query("first_non_empty", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, '') WHEN doc_id % 3 = 1 THEN coalesce(lang, '') ELSE '' END AS value FROM documents")
def first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents")
    a, b = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" NaN "), F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return d.select("doc_id", T.first_non_empty(a, b).alias("value"))


@query("manifest", "SELECT 'documents' AS \"table\", 'documents' AS dataset, 'train' AS split, true AS is_expert, count(*) AS n_rows FROM documents UNION ALL SELECT 'benchmark', 'benchmark', 'test', false, count(*) FROM benchmark")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = _parts(spark, sf_dir)
    return C.manifest({"documents": d, "benchmark": b})


@query("dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS annotation_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS in_source FROM documents")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.dense_ids(C.dense_ids(d, ["source", "doc_id"]), ["doc_id"], "in_source", ["source"]).select("doc_id", "annotation_id", "in_source")


@query("one_line", r"SELECT doc_id, md5(flat) AS flat, md5(replace(coalesce(flat, ''), '\n', chr(10))) AS restored FROM (SELECT doc_id, replace(replace(replace(replace(text, chr(13) || chr(10), '\n'), chr(13), '\n'), chr(10), '\n'), chr(9), ' ') AS flat FROM documents)")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.one_line("text").cast("binary")).alias("flat"), F.md5(T.restore_lines(T.one_line("text")).cast("binary")).alias("restored"))


@query("folds", "SELECT doc_id::VARCHAR AS note_id, (('0x' || substring(md5(doc_id::VARCHAR || '|42'), 1, 8))::BIGINT % 4)::INT AS fold FROM documents")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.folds(I.notes(spark, sf_dir).select("note_id"), "note_id")


@query("cross_validation", "SELECT fold, CASE WHEN fold < 4 THEN n // 5 ELSE n - 4 * (n // 5) END AS n FROM (SELECT count(*) AS n FROM benchmark), (SELECT unnest([0, 1, 2, 3, 4]) AS fold)")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validation(I.table(spark, sf_dir, "benchmark"), "item_id", 5).groupBy("fold").agg(F.count("*").alias("n"))


@query("file_round_trips", """WITH s AS (SELECT l_orderkey::VARCHAR AS note_id, l_linenumber::INT AS s, (l_linenumber + 5)::INT AS e, l_partkey AS c FROM lineitem)
SELECT 'spans' AS format, count(*) AS n, sum(c)::BIGINT AS total FROM s UNION ALL SELECT 'notes', count(*), sum(length(text))::BIGINT FROM documents UNION ALL SELECT 'lines', count(*), sum(length(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '\\n', chr(10))))::BIGINT FROM documents
UNION ALL SELECT 'json', count(*), sum(p_partkey)::BIGINT FROM part UNION ALL SELECT 'embeddings', count(*), sum(label)::BIGINT FROM embeddings UNION ALL SELECT 'graph', count(*), sum(s_nationkey)::BIGINT FROM supplier UNION ALL SELECT 'parts', count(*), sum(n_nationkey)::BIGINT FROM nation
UNION ALL SELECT 'rf2', count(*), sum(p_partkey)::BIGINT FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'omop', count(*), sum(p_partkey)::BIGINT FROM part""")
def file_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format written, read back, and summed up; one row a format. The files go at the end."""
    root = f"{shared_path(spark)}/round-trip-{uuid.uuid4().hex}"
    table = lambda name: I.table(spark, sf_dir, name)
    total = lambda df, name, value: df.agg(F.count("*").alias("n"), F.sum(value).cast("bigint").alias("total")).select(F.lit(name).alias("format"), "n", "total")
    place = lambda write, name: write(f"{root}/{name}") or f"{root}/{name}"
    spans = table("lineitem").select(F.col("l_orderkey").cast("string").alias("note_id"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 5).cast("int").alias("end"), F.col("l_partkey").alias("concept_id"))
    notes = I.notes(spark, sf_dir).select("note_id", "text")
    synonyms = table("part").select(F.col("p_partkey").alias("sctid"), F.array("p_name", "p_brand").alias("synonyms"))
    vectors = table("embeddings").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    nodes, edges = table("nation").select("n_nationkey", "n_name"), table("supplier").select("s_suppkey", "s_nationkey")
    rf2 = table("part").select(F.col("p_partkey").alias("id"), F.lit("2020").alias("effectiveTime"), F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(1).alias("active"), F.lit(1).alias("moduleId"), F.lit(2).alias("definitionStatusId"))
    omop = table("part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), *(F.lit("x").alias(c) for c in ("domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code", "valid_start_date", "valid_end_date", "invalid_reason")))
    tabbed = lambda df: lambda p: df.write.csv(p, sep="\t", header=True, quote="")
    read = [
        total(S.read_spans(spark, place(lambda p: S.write_csv(spans, p), "spans")), "spans", "concept_id"),
        total(S.read_notes(spark, place(lambda p: S.write_csv(notes, p), "notes")), "notes", F.length("text")),
        total(S.read_csv_oneline(spark, place(lambda p: S.write_csv_oneline(notes, p), "lines"), "note_id string, text string", ["text"]), "lines", F.length("text")),
        total(S.read_synonyms_json(spark, place(lambda p: S.write_synonyms_json(synonyms, p), "json")), "json", "sctid"),
        total(S.read_embeddings(spark, place(lambda p: vectors.write.parquet(p), "embeddings")), "embeddings", "label"),
        total(S.load_graph(spark, place(lambda p: S.save_graph(nodes, edges, p), "graph"))[1], "graph", "s_nationkey"),
        total(spark.read.parquet(place(lambda p: S.write_parts(table("nation"), p, ["n_regionkey"]), "parts")), "parts", "n_nationkey"),
        total(S.read_rf2(spark, place(tabbed(rf2), "rf2"), S.CONCEPT), "rf2", "id"),
        total(S.read_omop(spark, place(tabbed(omop), "omop"), S.OMOP_CONCEPT, ["concept_id"]), "omop", "concept_id"),
    ]
    found = cut_lineage(functools.reduce(DataFrame.unionByName, read))
    S.remove(spark, root)
    return found
