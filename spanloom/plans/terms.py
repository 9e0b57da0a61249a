"""Queries of terminology tables. Parts stand for concepts, benchmark words for names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import terminology as A
from . import inputs as I
from .registry import query

_NAMES = """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]'), lambda x: x <> '') AS ws FROM benchmark),
names AS (SELECT item_id AS concept_id, array_to_string(ws[1:2], ' ') || ' (finding)' AS name FROM w WHERE len(ws) >= 4 UNION ALL SELECT item_id + 100000, array_to_string(ws[1:3], ' ') || ' (disorder)' FROM w WHERE len(ws) >= 4),
edges AS (SELECT item_id + 100000 AS src, item_id AS dst FROM w WHERE len(ws) >= 4)
"""


def _words(spark, sf_dir):
    b = I.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.filter(F.split(F.lower("text"), "[^a-z0-9]"), lambda x: x != "").alias("ws")).where(F.size("ws") >= 4)


def _names(spark, sf_dir):
    w = _words(spark, sf_dir)
    take = lambda n, kind: F.concat(F.concat_ws(" ", F.slice("ws", 1, n)), F.lit(f" ({kind})"))
    return w.select(F.col("item_id").alias("concept_id"), take(2, "finding").alias("name")).unionByName(w.select((F.col("item_id") + 100000).alias("concept_id"), take(3, "disorder").alias("name")))


@query("term_extension", _NAMES + ", p AS (SELECT src, s.name AS sn, dst, d.name AS dn, list_distinct(string_split(string_split(lower(s.name), '(')[1], ' ')) AS sw, list_distinct(string_split(string_split(lower(d.name), '(')[1], ' ')) AS dw FROM edges JOIN names s ON s.concept_id = src JOIN names d ON d.concept_id = dst),\nq AS (SELECT *, list_filter(sw, lambda x: NOT list_contains(dw, x) AND NOT list_contains(" + repr(T.STOP_WORDS) + ", x)) AS more, list_filter(dw, lambda x: NOT list_contains(sw, x) AND NOT list_contains(" + repr(T.STOP_WORDS) + ", x)) AS less FROM p)\nSELECT dst AS general_id, dn AS general_name, src AS specific_id, sn AS specific_name, more[1] AS additional_word FROM q WHERE len(more) = 1 AND len(less) = 0")
def term_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir)
    e = _words(spark, sf_dir).select((F.col("item_id") + 100000).alias("src"), F.col("item_id").alias("dst"))
    a, b = (n.select(F.col("concept_id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
    return A.term_extensions(e.join(a, "src").join(b, "dst"))


@query("hierarchies", _NAMES + r"SELECT concept_id, CASE WHEN name LIKE '%(finding)' THEN 'finding' ELSE 'disorder' END AS hierarchy, 'finding' AS grouped, string_split(name, ' (')[1] AS term_name FROM names")
def hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("concept_id", T.hierarchy_of("name").alias("hierarchy"), A.remap(T.hierarchy_of("name"), A.GROUPS).alias("grouped"), T.term_name("name").alias("term_name"))


@query("synonyms_union", "SELECT concept_id, concept_name, hierarchy, type FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, concept_name ORDER BY part, ord) AS r FROM (SELECT p_partkey AS concept_id, p_brand AS concept_name, p_type AS hierarchy, 'SYN' AS type, 0 AS part, 0 AS ord FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END, p_type, 'FSN', 1, p_partkey FROM part)) WHERE r = 1")
def synonyms_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    terms = p.select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("hierarchy"))
    own = p.select(F.col("p_partkey").alias("concept_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("concept_name"), F.col("p_type").alias("hierarchy"), F.lit("FSN").alias("type"), F.col("p_partkey").alias("ord"))
    return A.synonyms_union(p.select(F.col("p_partkey").alias("concept_id"), F.col("p_brand").alias("concept_name")), own, terms)


@query("abbreviations", """WITH syn AS (SELECT p_partkey AS concept_id, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (' || substring(p_brand, 1, 12) || ')' END AS concept_name FROM part),
keys AS (SELECT lower(concept_name) AS k, concept_name, ord FROM syn UNION ALL SELECT string_split(lower(concept_name), ' (')[1], concept_name, ord FROM syn WHERE len(string_split(lower(concept_name), ' (')) <= 2 AND length(string_split(lower(concept_name), ' (')[-1]) <= 10),
first_ AS (SELECT k, arg_min(concept_name, ord) AS concept_name FROM keys GROUP BY k)
SELECT DISTINCT abbreviation, meaning, concept_id, f.concept_name FROM (SELECT 'A' || p_partkey AS abbreviation, upper(p_name) AS meaning FROM part WHERE p_partkey % 7 < 2) a JOIN first_ f ON f.k = lower(meaning) LEFT JOIN syn ON syn.concept_name = f.concept_name""")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), F.substring("p_brand", 1, 12), F.lit(")")))
    syn = p.select(F.col("p_partkey").alias("concept_id"), F.col("p_partkey").alias("ord"), name.alias("concept_name"))
    abbr = p.where("p_partkey % 7 < 2").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("abbreviation"), F.upper("p_name").alias("meaning"))
    return A.abbreviations(abbr, syn)


@query("unigrams", r"WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+')) AS word FROM documents) WHERE word <> '' GROUP BY word), b AS (SELECT DISTINCT item_id AS concept_id, lower(split_part(trim(text), ' ', 1)) AS word FROM benchmark) SELECT concept_id, b.word, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.word = c.word WHERE coalesce(n, 0) < 300 AND b.word <> ''")
def unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept_id"), F.split_part(F.trim("text"), F.lit(" "), F.lit(1)).alias("concept_name"))
    return A.unigrams(syn, D.corpus_word_count(I.notes(spark, sf_dir)), 300)


_KEYS = """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT concept_id, ord, mention FROM (SELECT item_id AS concept_id, item_id AS ord, array_to_string(ws[1:3 + item_id % 2], ' ') AS mention, row_number() OVER (PARTITION BY array_to_string(ws[1:3 + item_id % 2], ' ') ORDER BY item_id) AS r FROM w WHERE len(ws) >= 4) WHERE r = 1)
"""


def _keys(spark, sf_dir):
    w = _words(spark, sf_dir)
    d = w.select(F.lit("any").alias("section"), F.concat_ws(" ", F.slice("ws", F.lit(1), (3 + F.col("item_id") % 2).cast("int"))).alias("mention"), F.col("item_id").alias("concept_id"), F.col("item_id").alias("ord"))
    return d.groupBy("section", "mention").agg(F.min_by("concept_id", "ord").alias("concept_id"), F.min("ord").alias("ord"))


@query("word_replacements", _KEYS + ", m AS (SELECT replace(mention, a, b) AS mention, concept_id, ord, r FROM d, (VALUES (0, ',', ''), (1, ' and ', ' with '), (2, ' with ', ' and '), (3, ' valve ', ' '), (4, ' of ', ' of the ')) t(r, a, b) WHERE contains(mention, a)) SELECT 'any' AS section, mention, arg_max(concept_id, ord * 10 + r) AS concept_id FROM m GROUP BY mention")
def word_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_replacements(_keys(spark, sf_dir))


@query("permutations", _KEYS + """, s AS (SELECT *, string_split(mention, ' ') AS w FROM d),
p AS (SELECT concept_id, ord, w[3] || ' ' || w[1] AS mention FROM s WHERE len(w) = 3 AND w[2] = 'of'
UNION ALL SELECT concept_id, ord, w[3] || ' ' || w[4] || ' ' || w[1] FROM s WHERE len(w) = 4 AND w[2] = 'of'
UNION ALL SELECT concept_id, ord, unnest([w[4] || ' ' || w[1] || ' ' || w[2], w[1] || ' ' || w[4] || ' ' || w[2]]) FROM s WHERE len(w) = 4 AND w[2] <> 'of' AND w[3] = 'of'
UNION ALL SELECT concept_id, ord, w[i] || ' ' || w[j] || ' ' || w[6 - i - j] FROM s, range(1, 4) a(i), range(1, 4) b(j) WHERE i <> j AND len(w) = 3 AND w[2] <> 'of' AND NOT list_has_any(w, ['the', 'change'])
UNION ALL SELECT concept_id, ord, w[i] || ' ' || w[j] || ' ' || w[k] || ' ' || w[10 - i - j - k] FROM s, range(1, 5) a(i), range(1, 5) b(j), range(1, 5) c(k) WHERE i <> j AND i <> k AND j <> k AND len(w) = 4 AND w[2] <> 'of' AND w[3] <> 'of' AND NOT list_has_any(w, ['the', 'change']))
SELECT 'any' AS section, mention, arg_max(concept_id, ord) AS concept_id FROM p WHERE mention NOT IN (SELECT mention FROM d) GROUP BY mention""")
def permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_permutations(_keys(spark, sf_dir), spark.createDataFrame([("the",), ("change",)], "word string"))


@query("cond_update", _KEYS + ", m AS (SELECT mention, concept_id + 1000 AS new FROM d WHERE concept_id % 2 = 0), base AS (SELECT mention, concept_id FROM d WHERE concept_id % 3 <> 0) SELECT 'any' AS section, coalesce(base.mention, m.mention) AS mention, CASE WHEN base.concept_id IS NULL OR (new IS NOT NULL AND new % 4 = 0) THEN coalesce(new, base.concept_id) ELSE base.concept_id END AS concept_id FROM base FULL JOIN m ON base.mention = m.mention")
def cond_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keys(spark, sf_dir)
    more = k.where("concept_id % 2 = 0").select("section", "mention", (F.col("concept_id") + 1000).alias("concept_id"))
    names = more.select("concept_id", F.when(F.col("concept_id") % 4 == 0, F.col("mention")).otherwise("").alias("name"))
    return D.cond_update(k.where("concept_id % 3 <> 0").select("section", "mention", "concept_id"), more, names, spark.createDataFrame([("zzz",)], "word string"))


@query("process_term", "SELECT p_partkey, trim(substring(lower(p_name || ' (' || p_type || ')'), 1, length(p_name))) AS term FROM part")
def process_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select("p_partkey", T.process_term(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("term"))


_SIDES = """, sided AS (SELECT note_id, ord, s, e, c, greatest(coalesce(lag(e) OVER w + 1, 0), s - 20) AS l, lead(s) OVER w AS nx FROM system_d WINDOW w AS (PARTITION BY note_id ORDER BY s, e, ord)),
cut AS (SELECT x.*, CASE WHEN s > l THEN substring(text, l + 1, s - l) ELSE '' END AS bef, CASE WHEN least(coalesce(nx - 1, length(text) - 1), e + 20) > e THEN substring(text, e + 1, least(coalesce(nx - 1, length(text) - 1), e + 20) - e) ELSE '' END AS aft FROM sided x JOIN notes USING (note_id)),
split AS (SELECT *, list_filter(regexp_split_to_array(bef, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')[-2:] AS b, list_filter(regexp_split_to_array(aft, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')[1:2] AS a FROM cut),
tried AS (SELECT *, [len(list_filter(b, lambda x: x IN ('de', 'De', 'DE'))), len(list_filter(b, lambda x: x IN ('the', 'The', 'THE')))] AS nb, [len(list_filter(a, lambda x: x IN ('de', 'De', 'DE'))), len(list_filter(a, lambda x: x IN ('the', 'The', 'THE')))] AS na FROM split)
"""


@query("specialise", I.sql("system_d", _SIDES + """, won AS (SELECT *, CASE WHEN nb[1] > 0 THEN 1 WHEN nb[2] > 0 THEN 2 ELSE 0 END AS k FROM tried),
seen AS (SELECT *, k > 0 AND nb[k] = 1 AND CASE k WHEN 1 THEN b[-1] IN ('de', 'De', 'DE') ELSE b[-1] IN ('the', 'The', 'THE') END AS beside FROM won)
SELECT note_id, ord, (CASE WHEN beside THEN s - length(b[-1]) - (length(bef) - length(regexp_replace(bef, '[ \\t\\n\\r\\f\\x0B]+$', ''))) ELSE s END)::INT AS start, e AS "end", CASE WHEN k > 0 THEN c + 90000 ELSE c END AS concept_id FROM seen"""))
def specialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specialised(spark, sf_dir, False)


@query("specialise_after", I.sql("system_d", _SIDES + """, won AS (SELECT *, CASE WHEN nb[1] + na[1] > 0 THEN 1 WHEN nb[2] + na[2] > 0 THEN 2 ELSE 0 END AS k FROM tried),
seen AS (SELECT *, k > 0 AND nb[k] = 1 AND CASE k WHEN 1 THEN b[-1] IN ('de', 'De', 'DE') ELSE b[-1] IN ('the', 'The', 'THE') END AS beside, k > 0 AND nb[k] = 0 AND CASE k WHEN 1 THEN a[1] IN ('de', 'De', 'DE') ELSE a[1] IN ('the', 'The', 'THE') END AS behind FROM won)
SELECT note_id, ord, (CASE WHEN beside THEN s - length(b[-1]) - (length(bef) - length(regexp_replace(bef, '[ \\t\\n\\r\\f\\x0B]+$', ''))) ELSE s END)::INT AS start, (CASE WHEN behind THEN e + length(a[1]) + (length(aft) - length(regexp_replace(aft, '^[ \\t\\n\\r\\f\\x0B]+', ''))) ELSE e END)::INT AS "end", CASE WHEN k > 0 THEN c + 90000 ELSE c END AS concept_id FROM seen"""))
def specialise_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specialised(spark, sf_dir, True)


def _specialised(spark, sf_dir, after):
    spans = I.system_d(spark, sf_dir)
    ext = spans.select(F.col("concept_id").alias("general_id")).distinct().select("general_id", (F.col("general_id") + 90000).alias("specific_id"), F.explode(F.array(F.lit("the"), F.lit("de"))).alias("additional_word")).withColumn("ord", F.length("additional_word"))
    return A.specialise(spans, I.test_notes(spark, sf_dir).select("note_id", "text"), ext, after=after).select("note_id", "ord", "start", "end", "concept_id")


# --- the terminology chain: parts are concepts, their names descriptions, suppliers a second vocabulary -----------------
_KIND = "CASE p_partkey % 4 WHEN 0 THEN ' (finding)' WHEN 1 THEN ' (procedure)' WHEN 2 THEN ' (qualifier value)' ELSE '' END"
_LOADED = f"""WITH descr AS (SELECT p_partkey AS concept_id, p_name || {_KIND} AS concept_name, CASE p_partkey % 4 WHEN 0 THEN 'finding' WHEN 1 THEN 'procedure' WHEN 2 THEN 'qualifier value' END AS hierarchy, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'P' END AS name_type FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0),
loaded AS (SELECT * FROM descr WHERE hierarchy IS NOT NULL),
kept AS (SELECT concept_id, concept_name, hierarchy FROM loaded WHERE name_type = 'P' AND hierarchy <> 'qualifier value')
"""


def _descriptions(spark, sf_dir):
    p, key = I.table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(key % 4 == 0, " (finding)").when(key % 4 == 1, " (procedure)").when(key % 4 == 2, " (qualifier value)").otherwise("")
    type_id = F.when(key % 3 == 0, F.lit(A.SYNONYM)).otherwise(F.lit(A.FSN))
    return p.select(key.alias("conceptId"), F.concat("p_name", kind).alias("term"), type_id.alias("typeId"), F.when(key % 7 == 0, 0).otherwise(1).alias("active"), key.alias("ord"))


def _loaded(spark, sf_dir):
    key = F.col("p_partkey")
    concepts = I.table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 5 == 0, 0).otherwise(1).alias("active"))
    return A.load_terminology(concepts, _descriptions(spark, sf_dir))


@query("load_terminology", _LOADED + "SELECT * FROM loaded")
def load_terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)


@query("flattened_terminology", _LOADED + "SELECT * FROM kept")
def flattened_terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flattened_terminology(_loaded(spark, sf_dir))


_MAPPED = _LOADED + """, mapped AS (SELECT DISTINCT p_partkey AS concept_id, s_name AS concept_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 2 = 0),
own AS (SELECT k.concept_id, p_name || """ + _KIND + """ AS concept_name, hierarchy, CASE WHEN p_partkey % 3 = 0 THEN 'SYN' ELSE 'FSN' END AS type, p_partkey AS ord FROM kept k JOIN part ON p_partkey = k.concept_id),
every AS (SELECT m.concept_id, m.concept_name, hierarchy, 'SYN' AS type, 0 AS part, 0 AS ord FROM mapped m JOIN kept USING (concept_id) UNION ALL SELECT concept_id, concept_name, hierarchy, type, 1, ord FROM own),
synonyms AS (SELECT concept_id, concept_name, hierarchy, type FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, concept_name ORDER BY part, ord) AS r FROM every) WHERE r = 1)
"""


def _mapped(spark, sf_dir):
    parts = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), F.lit("SNOMED").alias("vocabulary_id"), F.col("p_partkey").cast("string").alias("concept_code"))
    even = F.when(F.col("s_suppkey") % 2 == 0, "MeSH").otherwise("other")
    more = I.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("concept_id"), F.col("s_name").alias("concept_name"), even.alias("vocabulary_id"), F.lit("x").alias("concept_code"))
    relations = I.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 10_000_000).alias("concept_id_1"), F.col("l_partkey").alias("concept_id_2"), F.lit("Maps to").alias("relationship_id"))
    return A.mapped_synonyms(parts.unionByName(more), relations, ["MeSH"])


@query("mapped_synonyms", _MAPPED + "SELECT * FROM mapped")
def mapped_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)


@query("synonym_chain", _MAPPED + "SELECT * FROM synonyms")
def synonym_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminology, mapped names, own names and their union as one run."""
    terms = A.flattened_terminology(_loaded(spark, sf_dir))
    return A.synonyms_union(_mapped(spark, sf_dir), A.own_synonyms(terms, _descriptions(spark, sf_dir)), terms)


@query("abbreviation_dictionary", "SELECT 'any' AS section, 'abb' || (p_partkey % 50) AS mention, arg_min(10000 - p_partkey, p_partkey) AS concept_id FROM part WHERE p_partkey % 50 >= 10 GROUP BY p_partkey % 50")
def abbreviation_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = I.table(spark, sf_dir, "part").select(F.concat(F.lit("abb"), (key % 50).cast("string")).alias("abbreviation"), (10_000 - key).alias("concept_id"), key.alias("ord"))
    return A.abbreviation_dictionary(rows, 5)


@query("edges_in", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) OR l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return A.edges_in(edges, I.table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("concept_id")))


@query("edge_names", "SELECT s_suppkey + 100 AS src, s_nationkey AS dst, 200 AS type, s_name AS src_name, n_name AS dst_name, 'is in' AS type_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = I.table(spark, sf_dir, "supplier"), I.table(spark, sf_dir, "nation")
    named = n.select(F.col("n_nationkey").cast("bigint").alias("concept_id"), F.col("n_name").alias("name"))
    named = named.unionByName(s.select((F.col("s_suppkey") + 100_000).cast("bigint").alias("concept_id"), F.col("s_name").alias("name")))
    named = named.unionByName(spark.range(1).select(F.lit(-200).cast("bigint").alias("concept_id"), F.lit("is in").alias("name")))
    edges = s.select((F.col("s_suppkey") + 100_000).cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"), F.lit(-200).cast("bigint").alias("type"))
    out = A.edge_names(edges, named)
    return out.select((F.col("src") - 99_900).alias("src"), "dst", (-F.col("type")).cast("int").alias("type"), "src_name", "dst_name", "type_name")


@query("clean_annotations", I.sql("named", "SELECT note_id, ord, trim(regexp_replace(substring(text, s + 1, e - s), '\\s+', ' ', 'g')) AS source, concept_text FROM named JOIN notes USING (note_id) LEFT JOIN (SELECT n_nationkey * 10 AS c, n_name AS concept_text FROM nation) USING (c)"))
def clean_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = I.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 10).cast("bigint").alias("concept_id"), F.col("n_name").alias("concept_name"))
    return A.clean_annotations(I.gold(spark, sf_dir), I.notes(spark, sf_dir), terms).select("note_id", "ord", "source", "concept_text")


@query("concept_class", I.sql("gold", "SELECT note_id, ord, CASE WHEN c % 3 = 0 THEN 'proc' WHEN c % 3 = 1 THEN 'body' ELSE 'find' END AS cls FROM gold WHERE c % 5 <> 4 OR c % 3 <> 2"))
def concept_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = I.gold(spark, sf_dir)
    ids = lambda test: gold.where(test).select("concept_id")
    found = A.concept_class(gold, ids("concept_id % 3 = 0"), ids("concept_id % 3 <= 1"), ids("concept_id % 5 <> 4"))
    return found.select("note_id", "ord", "cls")
