"""Whole runs over notes with sections: annotating, training, building the full dictionary, predicting; each with its SQL.

Conversations are the notes (see sectioned.py). The lexicon holds the majority mentions of one word and some pairs of words,
written with a space or a hyphen; phrases of benchmark items are the outside source.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import training as R
from ..operators.shared import cut_lineage
from . import inputs as I
from .registry import query
from .sectioned import _CORE, _SCORED, Study
from .terms import _KEYS, _keys

_BLACKLIST = ("the", "change")


# --- annotating ------------------------------------------------------------------------------------------------------
def pair_mentions(study: Study) -> DataFrame:
    """section (any), mention, concept_id: pairs of neighbouring words of four letters and more, in two spellings."""
    t = D.token_table(study.whole, ("conv_id",)).withColumn("tok2", F.lead("tok").over(W.partitionBy("note_id").orderBy("ord")))
    t = t.where((F.length("tok") >= 4) & (F.length("tok2") >= 4) & ((F.col("conv_id") + F.col("ord")) % 7 == 0))
    mention = F.concat("tok", F.when(F.length("tok") % 2 == 0, " ").otherwise("-"), "tok2")
    return t.groupBy(F.lit(D.ANY).alias("section"), mention.alias("mention")).agg(F.min(7000 + F.col("conv_id") % 4).cast("bigint").alias("concept_id"))


_PAIRS = """, follow AS (SELECT *, lead(tok) OVER (PARTITION BY note_id ORDER BY o) AS tok2, lead(e) OVER (PARTITION BY note_id ORDER BY o) AS e2 FROM toks),
pairs AS (SELECT 'any' AS section, tok || CASE WHEN length(tok) % 2 = 0 THEN ' ' ELSE '-' END || tok2 AS mention, min(7000 + conv_id % 4) AS c FROM follow WHERE length(tok) >= 4 AND length(tok2) >= 4 AND (conv_id + o) % 7 = 0 GROUP BY ALL),
gram AS (SELECT note_id, s, e, rtrim(tok, 's') AS fold FROM follow UNION ALL SELECT note_id, s, e2, tok || ' ' || rtrim(tok2, 's') FROM follow WHERE tok2 IS NOT NULL)"""


def hits_sql(lexicon: str, name: str, text: str) -> str:
    """Matches of `lexicon` (section, sections or null for any, mention, c; mentions of words parted by one space or hyphen) in
    the expression `text`, with overlaps."""
    return f"""
{name}_d AS (SELECT *, rtrim(replace(lower(mention), '-', ' '), 's') AS fold, replace(replace(mention, ' ', '\\s+'), '-', '[- ]') || 's*' AS pattern FROM {lexicon}),
{name}_c AS (SELECT g.note_id, g.s, g.e, d.section, d.sections, d.mention, d.c, {text} AS text FROM gram g JOIN {name}_d d USING (fold) JOIN snotes USING (note_id) WHERE d.fold <> '' AND g.s >= 100),
{name}_w AS (SELECT *, strpos(substring(text, s + 1), chr(10)) AS feed FROM {name}_c WHERE regexp_full_match(substring(text, s + 1, e - s), pattern_of(mention)) AND NOT regexp_matches(substring(text, s, 1), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substring(text, e + 1, 1), '[\\p{{L}}\\p{{N}}]')),
{name}_h AS (SELECT * EXCLUDE (text, feed) FROM {name}_w WHERE NOT regexp_matches(CASE WHEN feed > 0 THEN substring(text, 1, s + feed - 1) ELSE text END, ':[ \\t\\n\\r\\f\\x0B]*$')),
{name}_p AS (SELECT x.*, h.header FROM {name}_h x ASOF JOIN headers h ON x.note_id = h.note_id AND x.s >= h.s),
{name} AS (SELECT note_id, s, e, c, section, mention, CASE WHEN sections IS NULL OR len(sections) > 1 THEN 1 ELSE 0 END AS av, row_number() OVER (PARTITION BY note_id ORDER BY s, e, mention, section) AS ord
FROM {name}_p WHERE sections IS NULL OR len(list_filter(sections, lambda x: contains(x, header))) > 0)""".replace("pattern_of(mention)", "pattern").replace("d.c, " + text, "d.c, d.pattern, " + text)


_RECURSIVE = _CORE.replace("WITH ", "WITH RECURSIVE ", 1)
_LEXICON = ", lexicon AS (SELECT section, CASE WHEN section <> 'any' THEN [section] END AS sections, mention, c FROM core UNION ALL SELECT section, NULL, mention, c FROM pairs)"


@query("annotate", _RECURSIVE + _PAIRS + _LEXICON + "," + hits_sql("lexicon", "found", "lower(text)") + ",\n" + I.sweep_sql("found", "resolved") + ' SELECT note_id, s AS start, e AS "end", c AS concept_id, section, mention AS dict_entry FROM resolved')
def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the dictionary and of pairs in all notes, overlaps resolved."""
    study = Study(spark, sf_dir)
    low = R.lower_case(study.notes)
    entries = study.core.unionByName(pair_mentions(study))
    return D.annotate(low, study.headers, entries, 2).select("note_id", "start", "end", "concept_id", "section", "dict_entry")


# --- training --------------------------------------------------------------------------------------------------------
def _types(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id").distinct().withColumn("type", (F.col("concept_id") % 2).cast("string"))


def _words_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _BLACKLIST], "word string")


def _trained(got: R.Dictionaries) -> DataFrame:
    """Both dictionaries as one table."""
    low = got.entries.select(F.lit("entries").alias("part"), "section", "mention", "concept_id", F.array_join("sections", "|").alias("sections"))
    return low.unionByName(got.cased.select(F.lit("cased").alias("part"), "section", "mention", "concept_id", F.lit(None).cast("string").alias("sections")))


# keys pruned on their own notes, upper-case ones moved; words of the blacklist are never learned
_LEARNED = """, keyed AS (SELECT section, entry, count(DISTINCT CASE WHEN score = 1 THEN note_id END) AS p, count(DISTINCT CASE WHEN score = -1 THEN note_id END) AS m FROM scored GROUP BY section, entry),
pruned AS (SELECT section, mention, c FROM core WHERE (section, mention) NOT IN (SELECT (section, entry) FROM keyed WHERE p < CASE WHEN p = 1 THEN 1.0 WHEN section = 'any' THEN 0.3 ELSE 0.2 END * m)),
surfaces AS (SELECT g.tok AS mention, substring(n.text, g.s + 1, g.e - g.s) AS orig FROM sgold g JOIN snotes n USING (note_id)),
upper_ AS (SELECT mention FROM surfaces GROUP BY mention HAVING avg((orig = upper(orig))::INT) > 0.99),
cased AS (SELECT section, upper(mention) AS mention, c FROM pruned WHERE mention IN (SELECT mention FROM upper_)),
entries AS (SELECT * FROM pruned WHERE mention NOT IN (SELECT lower(mention) FROM cased)),
allowed AS (SELECT c % 2 AS type, array_to_string(list_sort(list(DISTINCT header)), '|') AS sections FROM sect WHERE header IS NOT NULL GROUP BY 1)"""
_BASE = _SCORED.replace("'change', 'iv')", "'change', 'iv')").replace("WITH ", _KEYS.rstrip() + ",\n", 1)


def _limited(keys: str) -> str:
    """`keys` (section, mention, c, typed) with the sections that any-section keys of a known type are held to, and the cased keys."""
    return f"""SELECT 'entries' AS part, section, mention, c AS concept_id, CASE WHEN section <> 'any' THEN section ELSE sections END AS sections FROM {keys} LEFT JOIN allowed ON typed AND type = c % 2
UNION ALL SELECT 'cased', section, mention, c, NULL FROM all_cased"""


def _cond(before: str, more: str, after: str) -> str:
    """cond_update(): `more` (section, mention, new, named) over `before` (section, mention, c)."""
    return f"{after} AS (SELECT coalesce(b.section, m.section) AS section, coalesce(b.mention, m.mention) AS mention, CASE WHEN b.c IS NULL OR coalesce(m.named, false) THEN coalesce(m.new, b.c) ELSE b.c END AS c FROM {before} b FULL JOIN {more} m ON b.section = m.section AND b.mention = m.mention)"


_GROW = f"""
fresh AS (SELECT 'any' AS section, mention, concept_id + 100000 AS new, (concept_id + 100000) % 4 = 0 AS named FROM d WHERE mention NOT IN ('the', 'change')),
{_cond("entries", "fresh", "grown1")},
swaps AS (SELECT section, replace(mention, a, b) AS mention, arg_max(c, section || chr(1) || mention || chr(1) || r) AS new FROM grown1, (VALUES (0, ',', ''), (1, ' and ', ' with '), (2, ' with ', ' and '), (3, ' valve ', ' '), (4, ' of ', ' of the ')) t(r, a, b) WHERE contains(mention, a) GROUP BY 1, 2),
swapped AS (SELECT *, coalesce(new >= 100000 AND new % 4 = 0 AND mention IN (SELECT mention FROM d WHERE concept_id + 100000 = new), false) AS named FROM swaps),
{_cond("grown1", "swapped", "grown2")},
split_ AS (SELECT *, string_split(mention, ' ') AS w FROM grown2),
turned AS (SELECT section, c, mention AS o, w[3] || ' ' || w[1] AS mention FROM split_ WHERE len(w) = 3 AND w[2] = 'of'
UNION ALL SELECT section, c, mention, w[3] || ' ' || w[4] || ' ' || w[1] FROM split_ WHERE len(w) = 4 AND w[2] = 'of'
UNION ALL SELECT section, c, mention, unnest([w[4] || ' ' || w[1] || ' ' || w[2], w[1] || ' ' || w[4] || ' ' || w[2]]) FROM split_ WHERE len(w) = 4 AND w[2] <> 'of' AND w[3] = 'of'
UNION ALL SELECT section, c, mention, w[i] || ' ' || w[j] || ' ' || w[6 - i - j] FROM split_, range(1, 4) a(i), range(1, 4) b(j) WHERE i <> j AND len(w) = 3 AND w[2] <> 'of' AND NOT list_has_any(w, ['the', 'change'])
UNION ALL SELECT section, c, mention, w[i] || ' ' || w[j] || ' ' || w[k] || ' ' || w[10 - i - j - k] FROM split_, range(1, 5) a(i), range(1, 5) b(j), range(1, 5) c_(k) WHERE i <> j AND i <> k AND j <> k AND len(w) = 4 AND w[2] <> 'of' AND w[3] <> 'of' AND NOT list_has_any(w, ['the', 'change'])),
turns AS (SELECT section, mention, arg_max(c, o) AS new, false AS named FROM turned t WHERE NOT EXISTS (SELECT 1 FROM grown2 g WHERE g.section = t.section AND g.mention = t.mention) GROUP BY 1, 2),
{_cond("grown2", "turns", "grown3")},
grown AS (SELECT *, c < 100000 OR c % 3 = 0 AS typed FROM grown3),
all_cased AS (SELECT * FROM cased)
"""


def _training_tables(study: Study) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outside source, names and types: a third of its concepts has a type, a quarter is named as its mention says."""
    outside = cut_lineage(_keys(study.whole.sparkSession, study.sf_dir).select("section", "mention", (F.col("concept_id") + 100000).alias("concept_id")))
    names = outside.where(F.col("concept_id") % 4 == 0).select("concept_id", F.col("mention").alias("name"))
    return outside, names, _types(study.gold.select("concept_id").unionByName(outside.where(F.col("concept_id") % 3 == 0).select("concept_id")))


@query("train_run", _BASE + _LEARNED + "," + _GROW + _limited("grown"))
def train_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn, prune, move upper-case keys, add an outside source, replacements and permutations, limit any-section keys."""
    study = Study(spark, sf_dir)
    outside, names, types = _training_tables(study)
    return _trained(R.train(study.notes, study.gold, I.HEADERS, [outside], names, _words_df(spark), types, 1))


_FULL = """, blocked AS (SELECT mention FROM d WHERE concept_id % 5 = 0 AND mention NOT IN (SELECT tok FROM sgold)),
outer_ AS (SELECT 'any' AS section, mention, concept_id + 100000 AS c FROM d UNION ALL SELECT 'any', tok, 5 FROM (SELECT DISTINCT tok FROM sgold WHERE length(tok) = 6)),
merged AS (SELECT *, true AS typed FROM entries UNION ALL SELECT *, c < 100000 OR c % 3 = 0 FROM outer_ x WHERE mention NOT IN (SELECT mention FROM blocked) AND NOT EXISTS (SELECT 1 FROM entries y WHERE y.section = x.section AND y.mention = x.mention)),
outer_cased AS (SELECT 'any' AS section, upper(mention) AS mention, concept_id + 200000 AS c FROM d WHERE mention NOT IN (SELECT mention FROM blocked)),
all_cased AS (SELECT * FROM cased UNION ALL SELECT * FROM outer_cased x WHERE NOT EXISTS (SELECT 1 FROM cased y WHERE y.section = x.section AND y.mention = x.mention))
"""


@query("full_dictionary", _BASE + _LEARNED + _FULL + _limited("merged"))
def full_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn, then merge a pre-built pair of dictionaries without mentions that only test notes have."""
    study = Study(spark, sf_dir)
    keys = cut_lineage(_keys(spark, sf_dir))
    seen = study.gold.join(study.notes, "note_id").select(*study.gold.columns, F.lower(F.expr("substring(text, start + 1, end - start)")).alias("mention"))
    known = seen.where(F.length("mention") == 6).select("mention").distinct()
    outside = keys.select("section", "mention", (F.col("concept_id") + 100000).alias("concept_id"))
    entries = outside.unionByName(known.select(F.lit(D.ANY).alias("section"), "mention", F.lit(5).cast("bigint").alias("concept_id")))
    cased = keys.select("section", F.upper("mention").alias("mention"), (F.col("concept_id") + 200000).alias("concept_id"))
    types = _types(study.gold.select("concept_id").unionByName(entries.where((F.col("concept_id") % 3 == 0) | (F.col("concept_id") < 100000)).select("concept_id")))
    test = keys.where("concept_id % 5 = 0").select("mention").unionByName(known)
    return _trained(R.build_full(study.notes, seen, test, I.HEADERS, R.Dictionaries(entries, cased), types, 1))


# --- predicting ------------------------------------------------------------------------------------------------------
_CASED = ", ".join(f"({list(s)[0]!r}, {list(s)}, {m!r}, {c})" if s else f"('any', NULL, {m!r}, {c})" for s, m, c in D.CASE_SENSITIVE)
_RAW = f""", surfaces AS (SELECT substring(n.text, g.s + 1, g.e - g.s) AS mention FROM toks g JOIN snotes n USING (note_id) WHERE length(tok) BETWEEN 4 AND 6),
capital AS (SELECT DISTINCT mention, length(mention) % 3 AS k FROM surfaces WHERE mention <> lower(mention)),
ranked AS (SELECT 'any' AS section, NULL::VARCHAR[] AS sections, mention, 9000 + length(mention) AS c, 0 AS r FROM capital WHERE k < 2 UNION ALL SELECT 'any', NULL, mention, 8000 + length(mention), 1 FROM capital WHERE k > 0
UNION ALL SELECT section, sections, mention, c, 2 FROM (VALUES {_CASED}) t(section, sections, mention, c)),
raw_lexicon AS (SELECT section, sections, mention, c FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(array_to_string(sections, '|'), 'any'), mention ORDER BY r DESC) AS x FROM ranked) WHERE x = 1)"""
_BOTH = """, both_passes AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY s, e, pass) AS ord FROM (SELECT note_id, s, e, c, section, mention, av, 0 AS pass FROM low_left UNION ALL SELECT note_id, s, e, c, section, mention, av, 1 FROM raw_left)),
"""


@query("predict_run", _RECURSIVE + _PAIRS + _LEXICON + _RAW + "," + hits_sql("lexicon", "low", "lower(text)") + ",\n" + I.sweep_sql("low", "low_left") + "," + hits_sql("raw_lexicon", "raw", "text") + ",\n" + I.sweep_sql("raw", "raw_left") + _BOTH + I.sweep_sql("both_passes", "final") + ' SELECT note_id, s AS start, e AS "end", c AS concept_id, mention AS dict_entry FROM final')
def predict_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes over all notes: the learned entries and pairs in lower case; abbreviations, cased and fixed keys in raw text."""
    study = Study(spark, sf_dir)
    words = D.token_table(study.notes).where(F.length("tok").between(4, 6))
    surfaces = words.join(study.notes, "note_id").select(F.expr("substring(text, start + 1, end - start)").alias("mention"))
    capital = cut_lineage(surfaces.where(F.col("mention") != F.lower("mention")).distinct().withColumn("k", F.length("mention") % 3))
    of = lambda where, base: capital.where(where).select(F.lit(D.ANY).alias("section"), "mention", (F.length("mention") + base).cast("bigint").alias("concept_id"))
    entries = study.core.unionByName(pair_mentions(study)).withColumn("sections", F.when(F.col("section") != D.ANY, F.array("section")))
    none = spark.createDataFrame([], "general_id long, specific_id long, additional_word string, ord int")
    got = R.predict(study.notes, I.HEADERS, R.Dictionaries(entries, of("k > 0", 8000)), of("k < 2", 9000), none, 2)
    return got.select("note_id", "start", "end", "concept_id", "dict_entry")
