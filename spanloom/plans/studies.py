"""Queries of the comparison study as a run, of counts kept by part, and of located painting."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import evaluate as E
from ..operators import increments
from ..operators import present as P
from ..operators import spans as S
from ..operators.shared import cut_lineage, shared_path
from . import inputs as I
from .registry import query
from .sectioned import _CORE, Study


# --- both pairs of the study -----------------------------------------------------------------------------------------
def _miou(name: str, spans: str) -> str:
    """Common tables up to {name}: the mean character IoU of `spans` (note_id, s, e, c, ord) with the test gold."""
    chars = lambda t: f"(SELECT note_id, pos, arg_max(c, ord) AS c FROM (SELECT note_id, ord, c, unnest(range(s, e)) AS pos FROM {t}) GROUP BY note_id, pos)"
    return f"""{name}_b AS (SELECT g.c AS g, p.c AS p FROM {chars("test_gold")} g FULL JOIN {chars(spans)} p USING (note_id, pos)),
{name}_t AS (SELECT g AS c, g IS NOT DISTINCT FROM p AS same FROM {name}_b WHERE g IS NOT NULL UNION ALL SELECT p, false FROM {name}_b WHERE p IS NOT NULL AND p IS DISTINCT FROM g),
{name} AS (SELECT avg(coalesce(b / nullif(n, 0), 0)) AS v FROM (SELECT d.c, count(*) FILTER (same) AS b, count(t.c) AS n FROM (SELECT c FROM test_gold UNION SELECT c FROM {spans}) d LEFT JOIN {name}_t t ON t.c = d.c GROUP BY d.c))"""


def _pair(pair: str, second: str) -> str:
    """The metrics of system_d and `second` as rows (pair, metric, value), with the tables that lead to them."""
    best = f"""{pair}_p AS (SELECT g.note_id, g.ord, p.s AS ps, p.e AS pe, p.c AS pc, p.ord AS po, greatest(0, least(g.e, p.e) - greatest(g.s, p.s))::DOUBLE / ((g.e - g.s) + (p.e - p.s) - greatest(0, least(g.e, p.e) - greatest(g.s, p.s))) AS iou FROM test_gold g JOIN {second} p ON g.note_id = p.note_id AND greatest(g.s, p.s) < least(g.e, p.e)),
{pair}_s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id, ord ORDER BY iou DESC, po) AS r FROM {pair}_p WHERE iou >= 0.5) WHERE r = 1),
{pair}_a AS (SELECT g.note_id, g.ord, coalesce(d.pc = g.c, false) AS dh, coalesce(s.pc = g.c, false) AS sh, coalesce(d.iou, 0) >= coalesce(s.iou, 0) AS ahead, d.ps AS ds, d.pe AS de, d.pc AS dc, s.ps AS ss, s.pe AS se, s.pc AS sc FROM test_gold g LEFT JOIN best_d d USING (note_id, ord) LEFT JOIN {pair}_s s USING (note_id, ord)),
{pair}_o AS (SELECT note_id, ord, CASE WHEN t THEN ds ELSE ss END AS s, CASE WHEN t THEN de ELSE se END AS e, CASE WHEN t THEN dc ELSE sc END AS c FROM (SELECT *, dh AND (NOT sh OR ahead) AS t FROM {pair}_a WHERE dh OR sh))"""
    scores = ",\n".join(_miou(f"{pair}_m{i}", t) for i, t in enumerate(("system_d", second, f"{pair}_o")))
    values = f"""SELECT '{pair}' AS pair, unnest(['recall_d', 'recall_s', 'recall_oracle', 'miou_d', 'miou_s', 'miou_oracle', 'delta_recall', 'delta_miou']) AS metric, unnest([rd, rs, ro, md, ms, mo, ro - greatest(rd, rs), mo - greatest(md, ms)]) AS value
FROM (SELECT avg(dh::INT) AS rd, avg(sh::INT) AS rs, avg((dh OR sh)::INT) AS ro FROM {pair}_a), (SELECT v AS md FROM {pair}_m0), (SELECT v AS ms FROM {pair}_m1), (SELECT v AS mo FROM {pair}_m2)"""
    return best + ",\n" + scores + f",\n{pair}_v AS ({values})"


_RESIDUAL = "residual AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY s, e, c) - 1 AS ord FROM (SELECT x.note_id, x.s, x.e, x.c FROM system_s x JOIN notes n USING (note_id) LEFT JOIN lexicon l ON l.term = trim(regexp_replace(lower(substring(text, s + 1, e - s)), '[^a-z0-9]+', ' ', 'g')) WHERE l.c IS NULL OR l.c <> x.c))"
_METRICS = "SELECT pair, metric, round(value, 6) AS value FROM (SELECT * FROM a_v UNION ALL SELECT * FROM b_v)"


@query("holdout_metrics", I.sql("best_d", ", " + _RESIDUAL + ",\n" + _pair("a", "system_s") + ",\n" + _pair("b", "residual") + "\n" + _METRICS))
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and character IoU of both pairs of the study, their oracles, and what those gain: eight numbers a pair."""
    counted = cut_lineage(I.counted_terms(spark, sf_dir))
    found = (I.gold(spark, sf_dir, "doc_id % 5 = 0"), I.system_d(spark, sf_dir, named=False, counted=counted), I.system_s(spark, sf_dir))
    gold, d, s = (cut_lineage(x) for x in found)
    beyond = cut_lineage(S.with_order(S.neural_residual(s, I.test_notes(spark, sf_dir), D.majority_terms(counted)), "start", "end", "concept_id"))
    rows = [(pair, k, float(v)) for pair, second in (("a", s), ("b", beyond)) for k, v in E.compare(gold, d, second)[0].items()]
    return spark.createDataFrame(rows, "pair string, metric string, value double").withColumn("value", F.round("value", 6))


# --- counts by part --------------------------------------------------------------------------------------------------
@query("merged_dictionary", _CORE + "SELECT section, mention, c AS concept_id FROM core")
def merged_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section dictionary from counts of four parts of the notes: two compacted to one, one stored twice."""
    study = Study(spark, sf_dir)
    store = increments.CountStore(spark, f"{shared_path(spark)}/counts-{uuid.uuid4().hex}")
    counted = lambda i: D.section_counts(study.placed.where(F.col("conv_id") % 4 == i), study.notes)
    for i in (0, 1):
        store.put(f"part{i}", counted(i))
    store.compact("old")
    for i in (2, 3, 3):
        store.put(f"part{i}", counted(i))
    return store.section_dictionary()


# --- located painting ------------------------------------------------------------------------------------------------
_LOCATED = """, iv AS (SELECT DISTINCT note_id, s, e, 0 AS k, 'loc-' || s || '-' || e AS name FROM test_gold UNION SELECT note_id, s, e, 1, CASE c % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END FROM system_d),
edge AS (SELECT note_id, s AS a FROM iv UNION SELECT note_id, e FROM iv UNION SELECT note_id, 0 FROM notes WHERE doc_id % 5 = 0 UNION SELECT note_id, length(coalesce(text, '')) FROM notes WHERE doc_id % 5 = 0),
seg AS (SELECT note_id, a, coalesce(lead(a) OVER (PARTITION BY note_id ORDER BY a), a) AS z FROM edge),
st AS (SELECT seg.note_id, a, z, coalesce(list({'s': iv.s, 'e': -iv.e, 'k': k, 'n': name} ORDER BY iv.s, -iv.e, k, name) FILTER (k IS NOT NULL), []) AS stack FROM seg LEFT JOIN iv ON iv.note_id = seg.note_id AND iv.s <= a AND a < iv.e GROUP BY seg.note_id, a, z),
pv AS (SELECT *, coalesce(lag(stack) OVER (PARTITION BY note_id ORDER BY a), []) AS before FROM st),
sh AS (SELECT *, len(list_filter(range(1, 1 + least(len(stack), len(before))), lambda i: stack[1:i] = before[1:i])) AS same FROM pv),
pc AS (SELECT sh.note_id, a, array_to_string(list_transform(list_reverse(before[same + 1:]), lambda x: CASE WHEN x.k = 1 THEN '</mark>' ELSE '</span>' END), '')
|| array_to_string(list_transform(stack[same + 1:], lambda x: CASE WHEN x.k = 1 THEN '<mark class="' || x.n || '">' WHEN x.s = a THEN '<span id="' || x.n || '">' ELSE '<span data-loc="' || x.n || '">' END), '')
|| replace(replace(replace(replace(replace(substring(coalesce(text, ''), a + 1, z - a), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM sh JOIN notes USING (note_id))
SELECT note_id, md5(string_agg(html, '' ORDER BY a)) AS html FROM pc GROUP BY note_id"""


@query("located_html", I.sql("test_gold", _LOCATED + " -- system_d"))
def located_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test notes with the first system's spans in colour and gold spans located; both overlap each other at will."""
    kind = F.when(F.col("concept_id") % 3 == 0, "red").when(F.col("concept_id") % 3 == 1, "yellow").otherwise("green")
    colours, gold = cut_lineage(I.system_d(spark, sf_dir).withColumn("class", kind)), cut_lineage(I.gold(spark, sf_dir, "doc_id % 5 = 0"))
    html = P.located_html(I.test_notes(spark, sf_dir), colours, gold)
    return html.select("note_id", F.md5(F.col("html").cast("binary")).alias("html"))
