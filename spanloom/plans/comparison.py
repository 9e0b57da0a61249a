"""Queries that score and compare the two systems."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import present as P
from ..operators.shared import cut_lineage
from . import inputs as I
from .registry import query


def _gold(spark, sf_dir):
    """Written once: a query reads it several times."""
    return cut_lineage(I.gold(spark, sf_dir, "doc_id % 5 = 0"))


def _system_d(spark, sf_dir, named=False):
    """Written once as well; where it is read once, I.system_d() is enough."""
    return cut_lineage(I.system_d(spark, sf_dir, named))


def _aligned(spark, sf_dir):
    return E.add_regimes(E.attach_hits(_gold(spark, sf_dir), _system_d(spark, sf_dir), cut_lineage(I.system_s(spark, sf_dir))))


@query("best_alignment", I.sql("best_d", "SELECT g.note_id, g.ord, g.s AS gold_start, g.e AS gold_end, g.c AS gold_concept_id, ps AS pred_start, pe AS pred_end, pc AS pred_concept_id, round(coalesce(iou, 0), 6) AS span_iou FROM test_gold g LEFT JOIN best_d USING (note_id, ord)"))
def best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_alignment(_gold(spark, sf_dir), I.system_d(spark, sf_dir, named=False)).withColumn("span_iou", F.round("span_iou", 6))


@query("mention_recall", I.sql("aligned", "SELECT count(*) AS n_gold, count(*) FILTER (dh) AS n_hits, round(avg(dh::INT), 6) AS recall FROM aligned"))
def mention_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mention_recall(_gold(spark, sf_dir), I.system_d(spark, sf_dir, named=False)).withColumn("recall", F.round("recall", 6))


@query("oracle_spans", I.sql("aligned", "SELECT note_id, ord, CASE WHEN t THEN ds ELSE ss END AS start, CASE WHEN t THEN de ELSE se END AS \"end\", CASE WHEN t THEN dc ELSE sc END AS concept_id, CASE WHEN t THEN 'dict' ELSE 'linker' END AS source FROM (SELECT *, dh AND (NOT sh OR di >= si) AS t FROM aligned WHERE dh OR sh)"))
def oracle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.oracle_spans(_aligned(spark, sf_dir))


@query("regimes", I.sql("regimes", "SELECT note_id, ord, gc AS gold_concept_id, dc AS d_concept_id, sc AS s_concept_id, dh AS d_hit, sh AS s_hit, oh AS oracle_hit, regime FROM regimes"))
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("note_id", "ord", "gold_concept_id", "d_concept_id", "s_concept_id", "d_hit", "s_hit", "oracle_hit", "regime")


@query("regime_table", I.sql("regimes", "SELECT regime, count(*) AS n, round(1 - avg(oh::INT), 6) AS p_error, count(*) FILTER (dh AND NOT sh) AS d_only_correct, count(*) FILTER (sh AND NOT dh) AS s_only_correct, count(*) FILTER (dh AND sh) AS both_correct, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM regimes GROUP BY regime"))
def regime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regime_table(_aligned(spark, sf_dir)).withColumns({"p_error": F.round("p_error", 6), "pct": F.round("pct", 6)})


@query("queue_metrics", I.sql("regimes", "SELECT n::DOUBLE AS n_mentions, err::DOUBLE AS n_errors, que::DOUBLE AS n_queue, round(que / n, 6) AS queue_coverage, round(err / n, 6) AS error_rate_all, round(CASE WHEN err > 0 THEN eq / err ELSE 1 END, 6) AS error_recall, round(CASE WHEN que > 0 THEN eq / que ELSE 0 END, 6) AS error_precision, ea::DOUBLE AS n_errors_in_accord, round(CASE WHEN err > 0 THEN ea / err ELSE 0 END, 6) AS accord_error_share FROM (SELECT greatest(count(*), 1) AS n, count(*) FILTER (NOT oh) AS err, count(*) FILTER (regime <> 'ACCORD') AS que, count(*) FILTER (regime <> 'ACCORD' AND NOT oh) AS eq, count(*) FILTER (regime = 'ACCORD' AND NOT oh) AS ea FROM regimes)"))
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.queue_metrics(_aligned(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("queue_coverage", "error_rate_all", "error_recall", "error_precision", "accord_error_share")})


@query("queue_by_regime", I.sql("regimes", "SELECT regime, regime <> 'ACCORD' AS in_queue, count(*) AS n, count(*) FILTER (NOT oh) AS n_errors, round(avg((NOT oh)::INT), 6) AS p_error, round(count(*) FILTER (NOT oh) / greatest(sum(count(*) FILTER (NOT oh)) OVER (), 1), 6) AS share_of_all_errors FROM regimes GROUP BY regime"))
def queue_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.queue_by_regime(_aligned(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("p_error", "share_of_all_errors")})


@query("sample_examples", I.sql("regimes", "SELECT regime, note_id, ord, gs AS gold_start, ge AS gold_end, gc AS gold_concept_id FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(note_id || '|' || ord || '|0'), note_id, ord) AS r FROM regimes) WHERE r <= 2"))
def sample_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sample_examples(_aligned(spark, sf_dir), 2, 0).select("regime", "note_id", "ord", "gold_start", "gold_end", "gold_concept_id")


_CHARS = ", ".join(f"chars_{k} AS (SELECT note_id, pos, c FROM (SELECT *, row_number() OVER (PARTITION BY note_id, pos ORDER BY ord DESC) AS r FROM (SELECT note_id, ord, c, unnest(range(s, e)) AS pos FROM {t})) WHERE r = 1)" for k, t in (("g", "test_gold"), ("p", "system_d")))
_IOU = f""", {_CHARS},
both_ AS (SELECT g.c AS g, p.c AS p FROM chars_g g FULL JOIN chars_p p USING (note_id, pos)),
each_ AS (SELECT g AS c, g = p AS same FROM both_ WHERE g IS NOT NULL UNION ALL SELECT p, false FROM both_ WHERE p IS NOT NULL AND (g IS NULL OR g <> p)),
ious AS (SELECT d.c AS concept_id, count(*) FILTER (same) AS n_both, count(e.c) AS n_either FROM (SELECT c FROM test_gold UNION SELECT c FROM system_d) d LEFT JOIN each_ e ON e.c = d.c GROUP BY d.c)
"""


@query("char_iou", I.sql("test_gold", _IOU + "SELECT concept_id, n_both, n_either, round(coalesce(n_both / nullif(n_either, 0), 0), 6) AS iou FROM ious"))
def char_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.char_iou(_gold(spark, sf_dir), _system_d(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query("mean_char_iou", I.sql("test_gold", _IOU + "SELECT round(avg(coalesce(n_both / nullif(n_either, 0), 0)), 6) AS mean_iou FROM ious"))
def mean_char_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mean_char_iou(_gold(spark, sf_dir), _system_d(spark, sf_dir)).select(F.round("mean_iou", 6).alias("mean_iou"))


@query("note_jaccard", I.sql("test_gold", "SELECT note_id, round(len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))), 6) AS jaccard FROM (SELECT note_id, list(DISTINCT c) AS g FROM test_gold GROUP BY note_id) JOIN (SELECT note_id, list(DISTINCT c) AS p FROM system_d GROUP BY note_id) USING (note_id)"))
def note_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.note_jaccard(_gold(spark, sf_dir), _system_d(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


def _prf_sql(tp: str, fp: str, fn: str, rest: str) -> str:
    return f"SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT {tp} AS tp, {fp} AS fp, {fn} AS fn {rest})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("prf_exact", I.sql("test_gold", _prf_sql("count(*) FILTER (g.s IS NOT NULL AND p.s IS NOT NULL)", "count(*) FILTER (g.s IS NULL)", "count(*) FILTER (p.s IS NULL)", "FROM (SELECT DISTINCT note_id, s, e FROM test_gold) g FULL JOIN (SELECT DISTINCT note_id, s, e FROM system_d WHERE note_id IN (SELECT note_id FROM test_gold)) p USING (note_id, s, e)".replace("USING (note_id, s, e)", "ON g.note_id = p.note_id AND g.s = p.s AND g.e = p.e"))))
def prf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.prf_exact(I.gold(spark, sf_dir, "doc_id % 5 = 0"), I.system_d(spark, sf_dir, named=False)))


def _overlap_sql(same: str) -> str:
    hit = f"EXISTS (SELECT 1 FROM {{}} y WHERE y.note_id = x.note_id AND greatest(x.s, y.s) < least(x.e, y.e) {same})"
    return _prf_sql(f"(SELECT count(*) FROM system_d x WHERE {hit.format('test_gold')})", f"(SELECT count(*) FROM system_d x WHERE NOT {hit.format('test_gold')})", f"(SELECT count(*) FROM (SELECT DISTINCT note_id, s, e FROM test_gold x WHERE NOT {hit.format('system_d')}))", "")


@query("prf_overlap", I.sql("test_gold", _overlap_sql("")))
def prf_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.prf_overlap(_gold(spark, sf_dir), _system_d(spark, sf_dir)))


@query("prf_label", I.sql("test_gold", _overlap_sql("AND x.c = y.c")))
def prf_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.prf_overlap(_gold(spark, sf_dir), _system_d(spark, sf_dir), same_label=True))


_CLASSES = """, classes AS (SELECT note_id, s, e, CASE WHEN EXISTS (SELECT 1 FROM test_gold g WHERE g.note_id = x.note_id AND greatest(x.s, g.s) < least(x.e, g.e)) THEN 'green' ELSE 'yellow' END AS class FROM system_d x
UNION ALL SELECT note_id, s, e, 'red' FROM test_gold x WHERE NOT EXISTS (SELECT 1 FROM system_d p WHERE p.note_id = x.note_id AND greatest(x.s, p.s) < least(x.e, p.e)))
"""


@query("span_classes", I.sql("test_gold", _CLASSES + 'SELECT note_id, s AS start, e AS "end", class FROM classes'))
def span_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.span_classes(_gold(spark, sf_dir), _system_d(spark, sf_dir)).drop("ord")


@query("span_paint", I.sql("test_gold", _CLASSES + """, chars AS (SELECT note_id, unnest(range(s, e)) AS pos, CASE class WHEN 'red' THEN 3 WHEN 'yellow' THEN 2 ELSE 1 END AS r FROM classes),
tops AS (SELECT note_id, pos, max(r) AS r FROM chars GROUP BY note_id, pos),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY note_id, r ORDER BY pos) AS g FROM tops)
SELECT note_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end", CASE r WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' ELSE 'green' END AS class FROM runs GROUP BY note_id, r, g"""))
def span_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paint(E.span_classes(_gold(spark, sf_dir), _system_d(spark, sf_dir)))


@query("missed_gold", I.sql("test_gold", """, pred AS (SELECT *, length(term) / 12.0 AS score FROM system_d),
missed AS (SELECT * FROM named x WHERE doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM pred p WHERE p.note_id = x.note_id AND score >= 0.5 AND greatest(x.s, p.s) < least(x.e, p.e)))
SELECT note_id, ord, s AS start, e AS "end", c AS concept_id, CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.note_id = x.note_id AND score < 0.5 AND greatest(x.s, p.s) < least(x.e, p.e)) THEN 'filtered' WHEN term IN (SELECT term FROM lexicon) THEN 'in_dictionary' ELSE 'absent' END AS reason FROM missed x"""))
def missed_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as T
    from ..operators import spans as S

    gold = _gold(spark, sf_dir)
    named = S.with_surface(gold, I.test_notes(spark, sf_dir).select("note_id", "text")).withColumn("term", T.normalize_term("surface"))
    pred = _system_d(spark, sf_dir, named=True).withColumn("score", F.length("term") / 12.0)
    return E.missed_gold(gold, pred, I.lexicon(spark, sf_dir), named, 0.5)


@query("confusion_f1", "SELECT k AS class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM (SELECT k, sum(CASE WHEN quality = k AND toxic = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality <> k AND toxic = k THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = k AND toxic <> k THEN 1 ELSE 0 END) AS fn FROM labels, (SELECT DISTINCT quality AS k FROM labels UNION SELECT DISTINCT toxic FROM labels) WHERE quality = k OR toxic = k GROUP BY k)")
def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_scores(I.table(spark, sf_dir, "labels"), "quality", "toxic").withColumns({"f1": F.round("f1", 6), "iou": F.round("iou", 6)})


@query("confusion_matrix", "SELECT quality AS gold, toxic AS pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(I.table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("share", F.round("share", 6))


@query("label_auc", "SELECT round(sum(CASE WHEN a.doc_id > b.doc_id THEN 1.0 WHEN a.doc_id = b.doc_id THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT doc_id FROM labels WHERE quality = 1) a, (SELECT doc_id FROM labels WHERE quality = 0) b")
def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_auc(I.table(spark, sf_dir, "labels"), "quality", "doc_id").select(F.round("auc", 6).alias("auc"))


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.value_counts(I.table(spark, sf_dir, "documents"), "lang")


@query("scores_where_predicted", I.sql("test_gold", _IOU.replace("test_gold", "(SELECT * FROM test_gold WHERE note_id IN (SELECT note_id FROM system_d))") + ", j AS (SELECT note_id, len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) AS jaccard FROM (SELECT note_id, list(DISTINCT c) AS g FROM test_gold GROUP BY note_id) JOIN (SELECT note_id, list(DISTINCT c) AS p FROM system_d GROUP BY note_id) USING (note_id)) SELECT (SELECT round(avg(coalesce(n_both / nullif(n_either, 0), 0)), 6) FROM ious) AS mean_iou, (SELECT round(coalesce(avg(jaccard), 0), 6) FROM j) AS mean_jaccard"))
def scores_where_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.scores_where_predicted(_gold(spark, sf_dir), _system_d(spark, sf_dir))
    return found.select(F.round("mean_iou", 6).alias("mean_iou"), F.round("mean_jaccard", 6).alias("mean_jaccard"))


@query("ovo_auc", """WITH x AS (SELECT vec_id, label % 4 AS y, list_transform(embedding[1:4], lambda v: round(v::DOUBLE, 2)) AS p FROM embeddings),
pairs AS (SELECT a.y AS a, b.y AS b, avg(CASE WHEN a.p[a.y + 1] > b.p[a.y + 1] THEN 1.0 WHEN a.p[a.y + 1] = b.p[a.y + 1] THEN 0.5 ELSE 0 END) AS auc FROM x a JOIN x b ON a.y <> b.y GROUP BY a.y, b.y)
SELECT round(avg(auc), 6) AS auc FROM pairs""")
def ovo_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("y"), F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 2)).alias("p"))
    return E.one_vs_one_auc(v, "y", "p", 4).select(F.round("auc", 6).alias("auc"))
