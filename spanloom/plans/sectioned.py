"""Queries over notes with sections: conversations with a header line before each turn."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import sections as H
from ..operators import spans as S
from ..operators.shared import cut_lineage
from . import inputs as I
from .registry import query

# a line that ends with a colon before a blank line is a header; each turn begins with one
_LINES = """WITH snotes AS (SELECT conv_id::VARCHAR AS note_id, conv_id, string_agg(coalesce(role, '') || ':' || chr(10) || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
lines AS (SELECT note_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, length(text) AS size FROM (SELECT note_id, text, string_split(text, chr(10)) AS ls FROM snotes)),
placed AS (SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS pos, trim(line) AS l, lead(trim(line)) OVER (PARTITION BY note_id ORDER BY i) AS nx FROM lines),
heads AS (SELECT note_id, pos, size, CASE WHEN l IN ('user:', 'assistant:') THEN l ELSE 'other' END AS header FROM placed WHERE l LIKE '%:' AND nx = ''),
headers AS (SELECT note_id, pos AS s, coalesce(lead(pos) OVER (PARTITION BY note_id ORDER BY pos), size)::INT AS e, header FROM heads),
stok AS (SELECT note_id, conv_id, i, tok, (coalesce(sum(length(tok) + 1) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s FROM (SELECT note_id, conv_id, unnest(range(len(p))) AS i, unnest(p) AS tok FROM (SELECT note_id, conv_id, regexp_split_to_array(lower(text), '[^a-z0-9]') AS p FROM snotes))),
toks AS (SELECT note_id, conv_id, row_number() OVER (PARTITION BY note_id ORDER BY i) - 1 AS o, tok, s, s + length(tok)::INT AS e FROM stok WHERE tok <> ''),
sgold AS (SELECT *, length(tok) * 10 + conv_id % 3 AS c, row_number() OVER (PARTITION BY note_id ORDER BY s) - 1 AS ord FROM toks WHERE length(tok) >= 5 AND (conv_id + o) % 3 = 0),
sect AS (SELECT * FROM (SELECT g.*, h.header, row_number() OVER (PARTITION BY g.note_id, g.ord ORDER BY h.s DESC) AS r FROM sgold g LEFT JOIN headers h ON h.note_id = g.note_id AND h.s <= g.s) WHERE r = 1)
"""


def _notes(spark, sf_dir):
    return I.sectioned_notes(spark, sf_dir)


def _headers(spark, sf_dir):
    return H.section_headers(_notes(spark, sf_dir).select("note_id", "text"), I.HEADERS)


def _gold_of(notes):
    t = D.token_table(notes, ("conv_id",)).where((F.length("tok") >= 5) & ((F.col("conv_id") + F.col("ord")) % 3 == 0))
    g = t.select("note_id", "start", "end", (F.length("tok") * 10 + F.col("conv_id") % 3).cast("bigint").alias("concept_id"), "conv_id")
    return S.with_order(g, "start").withColumn("seen", F.col("conv_id") * 1000000 + F.col("ord"))


def _gold(spark, sf_dir):
    return _gold_of(_notes(spark, sf_dir))


def _placed(spark, sf_dir):
    return H.at_section(_gold(spark, sf_dir), _headers(spark, sf_dir))


class Study:
    """What several steps of a query read, each written to the shared folder once: notes, headers, gold, dictionary."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir = sf_dir
        self.whole = cut_lineage(_notes(spark, sf_dir))
        self.notes = self.whole.select("note_id", "text")
        self.headers = cut_lineage(H.section_headers(self.notes, I.HEADERS))
        self.gold = cut_lineage(_gold_of(self.whole))
        self.placed = H.at_section(self.gold, self.headers).withColumnRenamed("header", "section")
        self.core = cut_lineage(D.section_dictionary(self.placed, self.notes))

    def hits(self) -> DataFrame:
        return cut_lineage(D.match_sections(self.notes, self.headers, self.core, 1))


@query("header_spans", _LINES + 'SELECT note_id, s AS start, e AS "end", header FROM headers')
def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir)


@query("section_asof", _LINES + 'SELECT note_id, ord, s AS start, e AS "end", c AS concept_id, header FROM sect')
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("note_id", "ord", "start", "end", "concept_id", "header")


@query("first_containing", _LINES + "SELECT note_id, ord, header FROM (SELECT g.note_id, g.ord, h.header, row_number() OVER (PARTITION BY g.note_id, g.ord ORDER BY h.s) AS r FROM sgold g LEFT JOIN headers h ON h.note_id = g.note_id AND h.s <= g.s AND g.s <= h.e) WHERE r = 1")
def first_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.first_containing(_gold(spark, sf_dir), _headers(spark, sf_dir)).select("note_id", "ord", "header")


@query("header_filter", _LINES + "SELECT note_id, count(*) AS n FROM sect WHERE header IS NULL OR header <> 'user:' GROUP BY note_id")
def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.drop_sections(_placed(spark, sf_dir), ("user:",)).groupBy("note_id").agg(F.count("*").alias("n"))


@query("allowed_sections", _LINES + "SELECT type, array_to_string(list_sort(list(DISTINCT header)), '|') AS sections FROM (SELECT c % 2 AS type, header FROM sect WHERE header IS NOT NULL) GROUP BY type")
def allowed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir).withColumnRenamed("header", "section")
    types = placed.select("concept_id", (F.col("concept_id") % 2).alias("type")).distinct()
    return H.allowed_sections(placed, types).select("type", F.array_join("sections", "|").alias("sections"))


_CORE = _LINES + """, both_ AS (SELECT tok AS mention, c, conv_id * 1000000 + ord AS seen, unnest([coalesce(header, 'any'), 'any']) AS section FROM sect WHERE tok NOT IN ('other', 'negative', 'follow up', 'mild', 'normal', 'inr', 'changes', 'change', 'iv')),
cnt AS (SELECT section, mention, c, count(*) AS n, min(seen) AS f FROM both_ GROUP BY ALL),
top AS (SELECT *, sum(n) OVER (PARTITION BY section, mention) AS total, row_number() OVER (PARTITION BY section, mention ORDER BY n DESC, f, c) AS r FROM cnt),
core AS (SELECT section, mention, c FROM top WHERE r = 1 AND (section <> 'any' OR n / total >= 0.5))
"""


@query("section_dictionary", _CORE + "SELECT section, mention, c AS concept_id FROM core")
def section_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).core


@query("section_match", _CORE + """SELECT t.note_id, t.s AS start, t.e AS "end", coalesce(a.c, b.c) AS concept_id, CASE WHEN a.c IS NOT NULL THEN header ELSE 'any' END AS section
FROM (SELECT * FROM (SELECT t.*, h.header, row_number() OVER (PARTITION BY t.note_id, t.o ORDER BY h.s DESC) AS r FROM toks t JOIN headers h ON h.note_id = t.note_id AND h.s <= t.s WHERE t.s >= 100) WHERE r = 1) t
LEFT JOIN core a ON a.section = t.header AND a.mention = t.tok LEFT JOIN core b ON b.section = 'any' AND b.mention = t.tok WHERE a.c IS NOT NULL OR b.c IS NOT NULL""")
def section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Study(spark, sf_dir)
    return D.predict_sections(study.notes, study.headers, study.core, 1).select("note_id", "start", "end", "concept_id", "section")


_SCORED = _CORE + """, hits AS (SELECT t.note_id, t.s, t.e, coalesce(a.c, b.c) AS c, CASE WHEN a.c IS NOT NULL THEN header ELSE 'any' END AS section, tok AS entry
FROM (SELECT * FROM (SELECT t.*, h.header, row_number() OVER (PARTITION BY t.note_id, t.o ORDER BY h.s DESC) AS r FROM toks t JOIN headers h ON h.note_id = t.note_id AND h.s <= t.s WHERE t.s >= 100) WHERE r = 1) t
LEFT JOIN core a ON a.section = t.header AND a.mention = t.tok LEFT JOIN core b ON b.section = 'any' AND b.mention = t.tok WHERE a.c IS NOT NULL OR b.c IS NOT NULL),
scored AS (SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM sgold g WHERE g.note_id = h.note_id AND g.s = h.s AND g.e = h.e AND g.c = h.c) THEN 1 ELSE -1 END AS score FROM hits h)
"""


@query("dictionary_pruned", _SCORED + """, keys AS (SELECT section, entry, count(DISTINCT CASE WHEN score = 1 THEN note_id END) AS p, count(DISTINCT CASE WHEN score = -1 THEN note_id END) AS m FROM scored GROUP BY section, entry)
SELECT section, mention, c AS concept_id FROM core WHERE (section, mention) NOT IN (SELECT (section, entry) FROM keys WHERE p < CASE WHEN p = 1 THEN 1.0 WHEN section = 'any' THEN 0.3 ELSE 0.2 END * m)""")
def dictionary_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full learner: majority keys pruned by how often they err on their own notes."""
    study = Study(spark, sf_dir)
    model = D.DictionaryModel(max_n=1).fit(study.notes, study.gold, study.headers)
    return model.entries.select("section", "mention", "concept_id")


@query("confidence_tau", _CORE + """, hits AS (SELECT t.note_id, t.s, t.e, coalesce(a.c, b.c) AS c, CASE WHEN a.c IS NOT NULL THEN header ELSE 'any' END AS section, tok AS entry
FROM (SELECT * FROM (SELECT t.*, h.header, row_number() OVER (PARTITION BY t.note_id, t.o ORDER BY h.s DESC) AS r FROM toks t JOIN headers h ON h.note_id = t.note_id AND h.s <= t.s WHERE t.s >= 100) WHERE r = 1) t
LEFT JOIN core a ON a.section = t.header AND a.mention = t.tok LEFT JOIN core b ON b.section = 'any' AND b.mention = t.tok WHERE a.c IS NOT NULL OR b.c IS NOT NULL),
scored AS (SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM sgold g WHERE g.note_id = h.note_id AND g.s = h.s AND g.e = h.e AND g.c = h.c) THEN 1 ELSE -1 END AS score FROM hits h),
keys AS (SELECT section, entry, count(*) FILTER (score = 1) AS p, count(*) FILTER (score = -1) AS m FROM scored GROUP BY section, entry)
SELECT h.note_id, h.s AS start, h.e AS "end", h.c AS concept_id, h.section, h.entry AS dict_entry, round(CASE WHEN p IS NULL THEN 1.0 ELSE p / (p + 0.3 * m) END, 6) AS confidence FROM hits h LEFT JOIN (SELECT section, entry, count(*) FILTER (score = 1) AS p, count(*) FILTER (score = -1) AS m FROM scored WHERE note_id::BIGINT % 2 = 0 GROUP BY section, entry) USING (section, entry)""")
def confidence_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Study(spark, sf_dir)
    hits = study.hits()
    scored = D.score_hits(hits, study.gold).where(F.col("note_id").cast("bigint") % 2 == 0)  # the training notes; other keys have 1
    found = D.confidence(hits.select("note_id", "start", "end", "concept_id", "section", "dict_entry"), scored)
    return found.withColumn("confidence", F.round("confidence", 6))


_CUT = """WITH base AS (SELECT doc_id::VARCHAR AS note_id, 'intro: ' || text || ' alpha: ' || text || ' omega: ' || text AS text FROM (SELECT item_id AS doc_id, replace(text, ':', ' ') AS text FROM benchmark)),
places AS (SELECT *, strpos(replace(lower(text), chr(10), ' '), 'alpha:') - 1 AS a, strpos(replace(lower(text), chr(10), ' '), 'omega:') - 1 AS b FROM base)
"""


@query("cut_sections", _CUT + "SELECT note_id, substring(text, 1, a) || substring(text, b + 1) AS text FROM places")
def cut_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("note_id"), F.replace("text", F.lit(":"), F.lit(" ")).alias("t"))
    n = b.select("note_id", F.concat(F.lit("intro: "), "t", F.lit(" alpha: "), "t", F.lit(" omega: "), "t").alias("text"))
    none = n.select("note_id", F.lit(0).alias("start"), F.lit(1).alias("end")).where("false")
    return H.cut_sections(n, none, ("intro:", "alpha:", "omega:"), ("alpha:",))[0]


@query("cut_section_spans", _CUT + """, words AS (SELECT note_id, a, b, unnest(range(0, length(text) - 9, 10)) AS s FROM places)
SELECT note_id, (CASE WHEN s >= b THEN s - (b - a) ELSE s END)::INT AS start, (CASE WHEN s >= b THEN s + 5 - (b - a) ELSE s + 5 END)::INT AS "end" FROM words WHERE s < a OR s >= b""")
def cut_section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("note_id"), F.replace("text", F.lit(":"), F.lit(" ")).alias("t"))
    n = b.select("note_id", F.concat(F.lit("intro: "), "t", F.lit(" alpha: "), "t", F.lit(" omega: "), "t").alias("text"))
    s = n.where(F.length("text") > 9).select("note_id", F.explode(F.sequence(F.lit(0), F.length("text") - 10, F.lit(10))).alias("start")).withColumn("end", F.col("start") + 5)
    return H.cut_sections(n, s, ("intro:", "alpha:", "omega:"), ("alpha:",))[1]


@query("precision_view", _SCORED + """, keys AS (SELECT section, entry, count(*) FILTER (score = 1) AS p, count(*) AS n FROM scored WHERE note_id::BIGINT % 2 = 0 GROUP BY section, entry)
SELECT note_id, s AS start, e AS "end", section, entry AS dict_entry, coalesce(p / n, 1.0) AS score, n IS NOT NULL AS seen_in_train FROM hits LEFT JOIN keys USING (section, entry)""")
def precision_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to 12 digits, since SQL and Spark round halves differently."""
    study = Study(spark, sf_dir)
    hits = study.hits()
    scored = D.score_hits(hits, study.gold).where(F.col("note_id").cast("bigint") % 2 == 0)
    return D.precision_view(hits.select("note_id", "start", "end", "section", "dict_entry"), scored, 12)
