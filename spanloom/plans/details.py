"""Queries of the operators that the other modules only use in passing; each runs over whole tables and has its SQL."""

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import graph as G
from ..operators import sections as H
from ..operators import spans as S
from ..operators import tags as N
from ..operators import terminology as A
from ..operators import vectors as V
from ..operators.shared import cut_lineage, shared_path
from ..sources import files
from . import inputs as I
from .registry import query
from .sectioned import _LINES, _SCORED, Study


# --- texts -----------------------------------------------------------------------------------------------------------
@query("cleaned_texts", r"""SELECT doc_id, md5(regexp_replace(text, '[^0-9A-Za-zÀ-ÖØ-öø-ÿœŒæÆ\s.,:\/\-'']', ' ', 'g')) AS french, md5(regexp_replace(text, '[^a-zA-Z\s.,:]', ' ', 'g')) AS inferred, md5(regexp_replace(text, '[^a-zA-Z0-9\s.,:\/]', ' ', 'g')) AS trained FROM documents""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.md5(c.cast("binary"))
    return I.table(spark, sf_dir, "documents").select("doc_id", of(T.french_clean("text")).alias("french"), of(T.infer_clean("text")).alias("inferred"), of(T.train_clean("text")).alias("trained"))


@query("single_space_offsets", "SELECT doc_id, n AS pos, n - (length(b) - length(regexp_replace(b, ' +', ' ', 'g'))) AS offset FROM (SELECT doc_id, length(text) // 2 AS n, left(t, length(t) // 2) AS b FROM (SELECT doc_id, text, replace(text, chr(10), '  ') AS t FROM documents))".replace("length(text) // 2 AS n", "length(t) // 2 AS n"))
def single_space_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each text, whose line feeds stand for two spaces, when runs of spaces become one."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("  ")).alias("t"))
    pos = F.floor(F.length("t") / 2).cast("int")
    return d.select("doc_id", pos.alias("pos"), T.single_space_offset("t", pos).alias("offset"))


@query("term_types", "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE p_type END AS type FROM part")
def term_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), "p_type", F.lit(")"))))
    return I.table(spark, sf_dir, "part").select("p_partkey", T.term_name(term).alias("name"), T.term_type(term).alias("type"))


# --- sections and spans ----------------------------------------------------------------------------------------------
_TITLES = _LINES + ", titles AS (SELECT note_id, s, s + length(CASE WHEN header = 'other' THEN 'x' ELSE header END) AS e FROM headers)"


def _titles(study: Study) -> DataFrame:
    """The characters of the header words themselves; one character where the header has no name."""
    return study.headers.select("note_id", "start", (F.col("start") + F.length(F.when(F.col("header") == "other", "x").otherwise(F.col("header")))).alias("end"))


def _spread(study: Study) -> DataFrame:
    """Every token as a span."""
    return D.token_table(study.notes).select("note_id", "ord", "start", "end")


@query("outside_headers", _TITLES + ' SELECT note_id, o AS ord, s AS start, e AS "end" FROM toks t WHERE NOT EXISTS (SELECT 1 FROM titles h WHERE h.note_id = t.note_id AND greatest(h.s, t.s) <= least(h.e, t.e))')
def outside_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Study(spark, sf_dir)
    return H.outside_headers(_spread(study), _titles(study))


@query("mask_headers", _TITLES + ' SELECT note_id, o AS ord, s AS start, e AS "end" FROM toks t WHERE NOT EXISTS (SELECT 1 FROM titles h WHERE h.note_id = t.note_id AND h.s <= t.s AND t.e <= h.e)')
def mask_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Study(spark, sf_dir)
    return H.mask_headers(_spread(study), _titles(study))


@query("trim_spans", I.sql("gold", ", wide AS (SELECT note_id, ord, greatest(s - 2, 0) AS s, least(e + 3, length(text)) AS e, text FROM gold JOIN notes USING (note_id)), t AS (SELECT *, substring(text, s + 1, e - s) AS x FROM wide), l AS (SELECT *, length(x) - length(regexp_replace(x, '^[ \\t\\n\\r\\f\\x0B]+', '')) AS a, length(x) - length(regexp_replace(x, '[ \\t\\n\\r\\f\\x0B]+$', '')) AS b FROM t) SELECT note_id, ord, (s + a)::INT AS start, (e - b)::INT AS \"end\" FROM l WHERE s + a < e - b"))
def trim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans with a few characters more on both sides."""
    n = I.notes(spark, sf_dir).select("note_id", "text")
    wide = I.gold(spark, sf_dir).join(n.select("note_id", F.length("text").alias("size")), "note_id")
    wide = wide.select("note_id", "ord", F.greatest(F.col("start") - 2, F.lit(0)).alias("start"), F.least(F.col("end") + 3, F.col("size")).alias("end"))
    return N.trim_spans(wide, n).select("note_id", "ord", "start", "end")


# --- windows of pieces -----------------------------------------------------------------------------------------------
_CHUNKS = ", chunks AS (SELECT note_id, ord // 30 AS chunk, list(length(tok) ORDER BY ord) AS ids, list(ord % 5 ORDER BY ord) AS labels FROM tokens GROUP BY ALL)"


def _chunks(spark, sf_dir):
    t = D.token_table(I.notes(spark, sf_dir)).select("note_id", "ord", F.length("tok").alias("ids"), (F.col("ord") % 5).alias("labels"))
    return N.token_windows(t, 32, ["ids", "labels"])


def _text(c) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("windows_with_special", I.sql("tokens", _CHUNKS + " SELECT note_id, chunk, '101 ' || array_to_string(ids, ' ') || ' 102' AS ids, '-100 ' || array_to_string(labels, ' ') || ' -100' AS labels, len(ids) + 2 AS mask FROM chunks"))
def windows_with_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = N.with_special(_chunks(spark, sf_dir), "ids", "labels", 101, 102)
    return w.select("note_id", "chunk", _text("ids").alias("ids"), _text("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("mask"))


@query("window_halves", I.sql("tokens", _CHUNKS + ", h AS (SELECT *, len(ids) // 2 AS k FROM chunks) SELECT note_id, chunk, 0 AS half, array_to_string(ids[1:k][1:7], ' ') AS ids FROM h UNION ALL SELECT note_id, chunk, 1, array_to_string(ids[k + 1:][1:7], ' ') FROM h"))
def window_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each window, cropped to seven pieces as outside training."""
    halves = N.halves(_chunks(spark, sf_dir).select("note_id", "chunk", "ids"), "ids")
    return N.crop(halves, "ids", 7, training=False).select("note_id", "chunk", "half", _text("ids").alias("ids"))


@query("cropped_windows", I.sql("tokens", _CHUNKS + " SELECT note_id, chunk, least(len(ids), 11) AS n, true AS inside FROM chunks"))
def cropped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eleven pieces at hashed places, which SQL can't repeat: their size, and whether they stand in the whole."""
    whole = _chunks(spark, sf_dir).select("note_id", "chunk", "ids").withColumn("whole", _text("ids"))
    cut = N.crop(whole, "ids", 11, training=True, seed=3)
    inside = F.contains(F.concat(F.lit(" "), "whole", F.lit(" ")), F.concat(F.lit(" "), _text("ids"), F.lit(" ")))
    return cut.select("note_id", "chunk", F.size("ids").alias("n"), inside.alias("inside"))


@query("tag_numbers", I.sql("gold", """, p AS (SELECT t.note_id, t.ord, g.ord AS g, t.ord = min(t.ord) OVER (PARTITION BY t.note_id, g.ord) AS first, g.c % 2 AS k FROM tokens t JOIN gold g ON g.note_id = t.note_id AND greatest(t.s, g.s) < least(t.e, g.e)),
q AS (SELECT note_id, ord, arg_max(1 + 2 * k + CASE WHEN first THEN 0 ELSE 1 END, g) AS tag FROM p GROUP BY note_id, ord) SELECT note_id, count(*) AS n, sum(coalesce(tag, 0) * (ord + 1))::BIGINT AS total FROM tokens LEFT JOIN q USING (note_id, ord) GROUP BY note_id"""))
def tag_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label numbers of all tokens, summed up by place for each note."""
    g = I.gold(spark, sf_dir).withColumn("cls", F.when(F.col("concept_id") % 2 == 0, "find").otherwise("proc"))
    ids = N.label_ids(["find", "proc"])
    number = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))[F.col("tag")]
    tagged = N.bio_encode(D.token_table(I.notes(spark, sf_dir)).select("note_id", "ord", "start", "end"), g)
    return tagged.groupBy("note_id").agg(F.count("*").alias("n"), F.sum(number * (F.col("ord") + 1)).alias("total"))


# --- dictionaries and terminology ------------------------------------------------------------------------------------
@query("common_words", r"WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+')) AS word FROM documents) WHERE word <> '' GROUP BY word) SELECT word FROM c WHERE n > 500 UNION SELECT unnest(['other', 'negative', 'follow up', 'mild', 'normal', 'inr', 'changes', 'change', 'iv'])")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.common_words(D.corpus_word_count(I.notes(spark, sf_dir)), 500)


@query("greedy_keys", _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + """, keyed AS (SELECT c, section, entry, count(DISTINCT CASE WHEN score = 1 THEN note_id END) AS p, count(DISTINCT CASE WHEN score = -1 THEN note_id END) AS m FROM scored GROUP BY c, section, entry),
counts AS MATERIALIZED (SELECT c, count(*) AS n FROM sgold GROUP BY c),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY -(p / (m + 0.01::DOUBLE)), section, entry) AS i, p / (m + 0.01::DOUBLE) AS ratio FROM keyed JOIN counts USING (c)),
fold AS (SELECT c, 0::BIGINT AS i, 0::HUGEINT AS r, 0::HUGEINT AS w, NULL::VARCHAR AS section, NULL::VARCHAR AS entry, false AS bad FROM counts
UNION ALL SELECT k.c, k.i, f.r + CASE WHEN keep THEN p ELSE 0 END, f.w + CASE WHEN keep THEN m ELSE 0 END, k.section, k.entry, NOT keep FROM fold f, LATERAL (SELECT x.*, coalesce(f.r::DOUBLE / nullif(f.w + n, 0) < ratio, false) OR NOT (p < CASE WHEN p = 1 THEN 1.0 ELSE (CASE WHEN x.section = 'any' THEN 0.3 ELSE 0.2 END) * CASE WHEN f.i > 2 THEN 2 ELSE 1 END END * m) AS keep FROM ranked x WHERE x.c = f.c AND x.i = f.i + 1) k)
SELECT c AS concept_id, section, entry AS dict_entry, bad FROM fold WHERE i > 0""")
def greedy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each concept's keys kept or not, in the order of their ratio, by what all kept ones reach."""
    study = Study(spark, sf_dir)
    scored = D.score_hits(study.hits(), study.gold)
    count = lambda v: F.count_distinct(F.when(F.col("score") == v, F.col("note_id")))
    keys = scored.groupBy("concept_id", "section", "dict_entry").agg(count(1).alias("n_correct"), count(-1).alias("n_incorrect"))
    return D.greedy_keys(keys, study.gold.groupBy("concept_id").agg(F.count("*").alias("n")))


@query("synonym_dictionary", """WITH n AS (SELECT p_partkey AS c, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (finding)' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' machine translation' ELSE p_brand || ' ' || p_name END AS name, p_partkey % 2 AS part FROM part),
m AS (SELECT c, part, trim(lower(CASE WHEN c % 4 = 0 THEN substring(name, 1, length(name) - 10) ELSE name END)) AS mention FROM n WHERE c % 4 <> 2 AND length(name) >= 3)
SELECT 'any' AS section, mention, arg_max(c, part * 1000000000 + c) AS concept_id FROM m WHERE len(string_split(mention, ' ')) BETWEEN 2 AND 5 GROUP BY mention""")
def synonym_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat("p_name", F.lit(" (finding)"))).when(key % 4 == 1, F.upper("p_name")).when(key % 4 == 2, F.concat("p_name", F.lit(" machine translation"))).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    p = I.table(spark, sf_dir, "part").select(key.alias("concept_id"), name.alias("concept_name"), key.alias("ord"))
    return A.synonym_dictionary(p.where("concept_id % 2 = 0"), p.where("concept_id % 2 = 1"))


# --- graphs ----------------------------------------------------------------------------------------------------------
def _graph(spark, sf_dir, collapse=False):
    """Parts are concepts, lines of orders relations: supplier to part, with the line's number as group and type."""
    key = F.col("p_partkey")
    d = I.table(spark, sf_dir, "part")
    full = d.select(key.alias("conceptId"), F.col("p_name").alias("term"), F.when(key % 3 == 0, F.lit(G.SYNONYM)).otherwise(F.lit(G.FSN)).alias("typeId"), F.when(key % 7 == 0, 0).otherwise(1).alias("active"), key.alias("ord"))
    short = d.select(key.alias("conceptId"), F.col("p_brand").alias("term"), F.lit(G.SYNONYM).alias("typeId"), F.lit(1).alias("active"), (key + 1_000_000).alias("ord"))
    r = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sourceId"), F.col("l_partkey").alias("destinationId"), F.col("l_linenumber").alias("typeId"), F.col("l_linenumber").alias("relationshipGroup"), F.when(F.col("l_quantity") < 5, 0).otherwise(1).alias("active"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return G.from_tables(full.unionByName(short), r, collapse)


_RELATED = """WITH r AS (SELECT l_suppkey AS src, l_partkey AS dst, l_linenumber AS type, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_quantity >= 5),
ends AS (SELECT src AS sctid FROM r UNION SELECT dst FROM r)
"""


@query("graph_nodes", _RELATED + "SELECT p_partkey AS sctid, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS fsn, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN p_name || '|' || p_brand ELSE p_brand END AS synonyms FROM part WHERE p_partkey IN (SELECT sctid FROM ends)")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("sctid", "fsn", F.array_join("synonyms", "|").alias("synonyms"))


@query("graph_edges", _RELATED + "SELECT src, dst, arg_max(type, o) AS type FROM r GROUP BY src, dst")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a pair: the last one."""
    return _graph(spark, sf_dir, True)[1].select("src", "dst", "type")


@query("relationship_types", _RELATED + "SELECT DISTINCT type FROM r")
def relationship_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relationship_types(_graph(spark, sf_dir)[1])


@query("class_synonyms", "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 10 AS dst FROM part WHERE p_partkey // 10 > 0), b(n) AS (SELECT src FROM e WHERE dst = 1 UNION SELECT e.src FROM b JOIN e ON e.dst = b.n) SELECT p_partkey AS sctid, p_name || '|' || p_brand AS synonyms FROM part WHERE p_partkey IN (SELECT n FROM b) UNION ALL SELECT -1, 'extra|one'")
def class_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").withColumn("sctid", F.col("p_partkey").cast("bigint"))
    edges = p.select(F.col("sctid").alias("src"), F.floor(F.col("sctid") / 10).cast("bigint").alias("dst"), F.lit(G.IS_A).alias("type")).where("dst > 0")
    nodes = p.select("sctid", F.array("p_name", "p_brand").alias("synonyms"))
    return G.class_synonyms(nodes, edges, 1, [(-1, ["extra", "one"])]).select("sctid", F.array_join("synonyms", "|").alias("synonyms"))


# --- corpora ---------------------------------------------------------------------------------------------------------
def _two_span_tables(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    place = (F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("end"))
    a = li.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("report"), *place, F.col("l_returnflag").alias("span"), F.col("l_linestatus").alias("label"), F.lit("x").alias("attribute_a"))
    b = li.where("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("note_id"), *place, F.col("l_returnflag").alias("extracted_span"), F.col("l_linestatus").alias("span_type"))
    return [C.tagged(a, "even", "train", True, "r/a"), C.tagged(b, "odd", "test", False, "r/b")]


@query("unify_spans", "SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, l_orderkey::VARCHAR AS note_id, l_linenumber::INT AS start, (l_linenumber + 3)::INT AS \"end\", l_returnflag AS span, l_linestatus AS label, CASE WHEN l_orderkey % 2 = 0 THEN 'x' END AS attribute_a FROM lineitem")
def unify_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unify_spans(_two_span_tables(spark, sf_dir)).select("dataset", "note_id", "start", "end", "span", "label", "attribute_a")


@query("french_view", "SELECT l_orderkey AS note_id, l_linenumber::INT AS start, (l_linenumber + 3)::INT AS \"end\", CASE WHEN l_orderkey % 3 = 0 THEN l_partkey::VARCHAR ELSE l_linestatus END AS label, l_returnflag AS text FROM lineitem")
def french_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = I.table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_linestatus"))
    return C.french_view(li.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("end"), label.alias("label"), F.col("l_partkey").alias("concept_id"), F.col("l_returnflag").alias("extracted_span")))


@query("notes_jsonl", "SELECT doc_id AS note_id, md5(coalesce(text, '')) AS text, coalesce(lang, '') AS doc_label FROM documents")
def notes_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report"), F.col("text").alias("full_text"), F.col("lang").alias("doc_label"))
    return C.notes_jsonl(d).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("present_columns", "SELECT l_partkey, l_orderkey, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three wanted columns two exist; the third comes by its prefix."""
    found = C.present(I.table(spark, sf_dir, "lineitem"), ["missing", "l_partkey", "l_orderkey"], prefix="l_q")
    return found.withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("notes_in_order", I.sql("gold", "SELECT note_id, ord, row_number() OVER (ORDER BY -doc_id, s, e, c) AS place FROM gold"))
def notes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold in the order of the notes from the last one: the places that the sort gives, counted without a single task."""
    n = I.notes(spark, sf_dir).select("note_id", (-F.col("doc_id")).alias("ord"))
    gold = I.gold(spark, sf_dir).select("note_id", F.col("ord").alias("own"), "start", "end", "concept_id")
    placed = C.in_order_of(gold, n, then=("start", "end", "concept_id")).withColumn("at", F.monotonically_increasing_id())
    return C.dense_ids(cut_lineage(placed), ["at"], "place").select("note_id", F.col("own").alias("ord"), "place")


@query("splits_in_order", "SELECT split, doc_id, row_number() OVER (ORDER BY split, doc_id) AS place FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, doc_id FROM documents)")
def splits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select("doc_id")
    rows = C.by_split({"train": d.where("doc_id % 5 <> 0"), "test": d.where("doc_id % 5 = 0")}, ["doc_id"]).withColumn("at", F.monotonically_increasing_id())
    return C.dense_ids(cut_lineage(rows), ["at"], "place").select("split", "doc_id", "place")


@query("exact_folds", "SELECT fold, CASE WHEN fold = 0 THEN n // 2 WHEN fold = 1 THEN n // 3 ELSE n - n // 2 - n // 3 END AS n, 1 AS most FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([0, 1, 2]) AS fold)")
def exact_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of folds by the rank of a hash that SQL doesn't have, and that no document is in two of them."""
    d = I.table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    folds = C.exact_folds(d, "doc_id", [n // 2, n // 3, n - n // 2 - n // 3])
    many = folds.groupBy("doc_id").agg(F.count("*").cast("int").alias("k"), F.first("fold").alias("fold"))
    return many.groupBy("fold").agg(F.count("*").alias("n"), F.max("k").alias("most"))


# --- losses ----------------------------------------------------------------------------------------------------------
@query("soft_losses", "WITH x AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda v: v::DOUBLE) AS z FROM embeddings) SELECT vec_id, CASE WHEN label % 5 = 4 THEN 0 ELSE 1 END AS mass, round(CASE WHEN label % 5 = 4 THEN 0 ELSE ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label % 5 + 1] END, 6) AS loss FROM x")
def soft_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of four logits with one-hot targets; the ignored label costs nothing."""
    v = I.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 5 == 4, N.IGNORED).otherwise(F.col("label") % 5).alias("y"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("z"))
    v = v.withColumn("t", V.one_hot("y", 4))
    return v.select("vec_id", F.aggregate("t", F.lit(0.0), lambda s, x: s + x).cast("int").alias("mass"), F.round(V.soft_cross_entropy("z", "t"), 6).alias("loss"))


# --- files, content by content ---------------------------------------------------------------------------------------
def _digest(rows: DataFrame, name: str, *columns) -> DataFrame:
    """Rows and the sum of 32 bits of the md5 of each row's cells, which any change of any cell changes."""
    cells = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("~")) for c in columns))
    bits = F.conv(F.substring(F.md5(cells.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).alias("digest")).select(F.lit(name).alias("format"), "n", "digest")


def _digest_sql(name: str, source: str, *cells: str) -> str:
    parts = ", ".join(f"coalesce(({c})::VARCHAR, '~')" for c in cells)
    return f"SELECT '{name}' AS format, count(*) AS n, coalesce(sum(('0x' || substring(md5(concat_ws('|', {parts})), 1, 8))::BIGINT), 0)::BIGINT AS digest FROM {source}"


_CONTENTS = " UNION ALL ".join([
    _digest_sql("rf2_quoted", "part WHERE p_partkey % 5 <> 0", "p_partkey", "'a\"b ' || p_name"),
    _digest_sql("texts_gz", "documents", "md5(text)"),
    _digest_sql("tables", "(SELECT 'x' AS d, 'train' AS p, n_nationkey, n_name FROM nation UNION ALL SELECT 'y', 'test', r_regionkey, r_name FROM region)", "d", "p", "n_nationkey", "n_name"),
    _digest_sql("synonyms", "part", "p_partkey", "p_name || '+' || p_brand"),
    _digest_sql("lexicon", "part", "p_name", "p_partkey"),
    _digest_sql("graph", "supplier JOIN nation ON s_nationkey = n_nationkey", "s_suppkey", "n_name"),
    _digest_sql("jsonl", "documents", "doc_id", "lang", "md5(text)"),
    _digest_sql("cached", "nation", "n_nationkey", "n_name"),
    _digest_sql("notes_csv", "documents", "doc_id", "md5(text)"),
    _digest_sql("report", "(SELECT unnest(['# Report', '', '| a | b |']) AS value)", "value"),
    _digest_sql("rewritten", "documents", "doc_id", "replace(replace(replace(replace(text, chr(13) || chr(10), '\\n'), chr(13), '\\n'), chr(10), '\\n'), chr(9), ' ')"),
])


@query("file_contents", _CONTENTS)
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format written and read back, compared cell by cell; the files go at the end."""
    root = f"{shared_path(spark)}/contents-{uuid.uuid4().hex}"
    table = lambda name: I.table(spark, sf_dir, name)
    part, docs = table("part"), table("documents")
    concept = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit('a"b '), "p_name").alias("effectiveTime"), F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(1).alias("active"), F.lit(1).alias("moduleId"), F.lit(2).alias("definitionStatusId"))
    concept.write.csv(f"{root}/rf2", sep="\t", header=True, quote='"', escape='"', quoteAll=True)
    files.write_csv(docs.select("doc_id", "text"), f"{root}/gz", compression="gzip")
    table("nation").select("n_nationkey", "n_name").write.parquet(f"{root}/tables/x/rows_train.parquet")
    table("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")).write.parquet(f"{root}/tables/y/rows_test.parquet")
    files.write_synonyms_json(part.select(F.col("p_partkey").alias("sctid"), F.array("p_name", "p_brand").alias("synonyms")), f"{root}/json")
    files.save_lexicon(part.select("p_name", "p_partkey"), f"{root}/lexicon")
    files.save_graph(table("nation").select("n_nationkey", "n_name"), table("supplier").select("s_suppkey", "s_nationkey"), f"{root}/graph")
    nodes, edges = files.load_graph(spark, f"{root}/graph")
    files.write_jsonl(docs.select("doc_id", "lang", "text"), f"{root}/jsonl")
    files.write_csv(docs.select(F.col("doc_id").alias("note_id"), "text"), f"{root}/notes")
    files.write_report("# Report\n\n| a | b |\n", f"{root}/report", spark)
    for _ in range(2):  # the second time it is there
        kept = files.cached(spark, f"{root}/cached", lambda: table("nation").select("n_nationkey", "n_name"))
    files.write_csv(docs.select("doc_id", "text"), f"{root}/folder/docs")
    files.rewrite_oneline(spark, f"{root}/folder", {"docs": "doc_id bigint, text string"})
    flat = files.read_csv(spark, f"{root}/folder/docs", "doc_id bigint, text string")
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    read = [
        _digest(files.read_rf2(spark, f"{root}/rf2", files.CONCEPT, quotes=True), "rf2_quoted", "id", "effectiveTime"),
        _digest(files.read_texts_gz(spark, f"{root}/gz", "doc_id bigint, text string", 4), "texts_gz", md5("text")),
        _digest(functools.reduce(DataFrame.unionByName, files.read_tables(spark, f"{root}/tables", [("x", "rows", "train"), ("y", "rows", "test")])), "tables", "dataset", "split", "n_nationkey", "n_name"),
        _digest(files.read_synonyms_json(spark, f"{root}/json"), "synonyms", "sctid", F.array_join("synonyms", "+")),
        _digest(spark.read.parquet(files.first_existing(spark, [f"{root}/none", f"{root}/lexicon"])), "lexicon", "p_name", "p_partkey"),
        _digest(edges.join(nodes, edges.s_nationkey == nodes.n_nationkey), "graph", "s_suppkey", "n_name"),
        _digest(files.read_jsonl(spark, f"{root}/jsonl", "doc_id bigint, lang string, text string"), "jsonl", "doc_id", "lang", md5("text")),
        _digest(kept, "cached", "n_nationkey", "n_name"),
        _digest(files.read_notes(spark, f"{root}/notes"), "notes_csv", "note_id", md5("text")),
        _digest(spark.read.text(f"{root}/report"), "report", "value"),
        _digest(flat, "rewritten", "doc_id", "text"),
    ]
    found = cut_lineage(functools.reduce(DataFrame.unionByName, read))
    files.remove(spark, root)
    return found
