"""Terminology tables: concepts with names, synonyms from mapped vocabularies, abbreviations, Is-A extensions, unigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

# Type ids and names, hierarchies and their three groups.
FSN, SYNONYM = 900000000000003001, 900000000000013009
TYPE_NAMES = {FSN: "FSN", SYNONYM: "SYN"}
HIERARCHIES = ("procedure", "body structure", "disorder", "finding", "morphologic abnormality", "cell structure", "regime/therapy")
GROUPS = {"procedure": "procedure", "body structure": "body structure", "disorder": "finding", "finding": "finding", "morphologic abnormality": "body structure", "cell structure": "body structure", "regime/therapy": "finding"}


def remap(column, mapping: dict) -> Column:
    """Values of the mapping replaced; others stay as they are."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(c.cast("string")) if out is not None else c


def not_in(column: str, values) -> Column:
    """NOT IN that keeps nulls."""
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def first_rows(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by an explicit order column."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose right keys must be unique; repeated ones raise."""
    repeated = right.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"right side repeats keys {keys}")
    return left.join(right, keys, how)


def load_terminology(concepts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """concept_id, concept_name, hierarchy, name_type (P preferred, A acceptable) of active concepts and descriptions; names
    without a hierarchy at their end go. concepts: id, active; descriptions: conceptId, term, typeId, active."""
    c, d = concepts.where("active = 1").select(F.col("id").alias("conceptId")), descriptions.where("active = 1")
    named = c.join(d, "conceptId").select(F.col("conceptId").alias("concept_id"), F.col("term").alias("concept_name"), T.hierarchy_of("term").alias("hierarchy"), remap("typeId", {FSN: "P", SYNONYM: "A"}).alias("name_type"))
    return named.where("hierarchy is not null")


def flattened_terminology(terms: DataFrame, hierarchies=HIERARCHIES) -> DataFrame:
    """Preferred names of the chosen hierarchies."""
    return terms.where(F.col("hierarchy").isin(*hierarchies) & (F.col("name_type") == "P")).select("concept_id", "concept_name", "hierarchy")


def clean_annotations(annotations: DataFrame, notes: DataFrame, terms: DataFrame) -> DataFrame:
    """Annotations with `source` (their slice, white space collapsed) and the concept's name."""
    from .spans import with_surface

    named = with_surface(annotations, notes, "__s").withColumn("source", T.collapse_ws("__s")).drop("__s")
    return named.join(terms.select("concept_id", F.col("concept_name").alias("concept_text")), "concept_id", "left")


def own_synonyms(terms: DataFrame, descriptions: DataFrame) -> DataFrame:
    """concept_id, concept_name, hierarchy, type of all descriptions of kept concepts, inactive ones too."""
    return terms.select("concept_id", "hierarchy").join(descriptions.select(F.col("conceptId").alias("concept_id"), F.col("term").alias("concept_name"), remap("typeId", TYPE_NAMES).alias("type"), "ord"), "concept_id")


def mapped_synonyms(concept: DataFrame, relationship: DataFrame, valid: list[str], vocabulary: str = "SNOMED") -> DataFrame:
    """concept_id, concept_name: names in other vocabularies that map to a concept code of ours.

    concept: concept_id, concept_name, vocabulary_id, concept_code; relationship: concept_id_1, concept_id_2,
    relationship_id. Codes must be unique per concept_id.
    """
    ours = concept.where(F.col("vocabulary_id") == vocabulary).select(F.col("concept_id").alias("concept_id_2"), F.col("concept_code").try_cast("bigint").alias("code"))
    others = concept.where(F.col("vocabulary_id").isin(*valid)).select(F.col("concept_id").alias("concept_id_1"), "concept_name")
    maps = relationship.where("relationship_id = 'Maps to'").select("concept_id_1", "concept_id_2")
    return many_to_one(many_to_one(maps, ours, ["concept_id_2"]), others, ["concept_id_1"]).select(F.col("code").alias("concept_id"), "concept_name").distinct()


def synonyms_union(mapped: DataFrame, own: DataFrame, terms: DataFrame) -> DataFrame:
    """concept_id, concept_name, hierarchy, type: mapped names as synonyms, then own ones; the first of equal (id, name)."""
    m = mapped.join(terms.select("concept_id", "hierarchy"), "concept_id").select("concept_id", "concept_name", "hierarchy", F.lit("SYN").alias("type"), F.lit(0).alias("__part"), F.lit(0).cast("bigint").alias("ord"))
    both = m.unionByName(own.select("concept_id", "concept_name", "hierarchy", "type", F.lit(1).alias("__part"), F.col("ord").cast("bigint").alias("ord")))
    kept = first_rows(both.withColumn("__at", F.struct("__part", "ord", "hierarchy", "type")), ["concept_id", "concept_name"], "__at")
    return kept.select("concept_id", "concept_name", "hierarchy", "type")


def abbreviations(abbr: DataFrame, synonyms: DataFrame) -> DataFrame:
    """abbreviation, meaning, concept_id, concept_name: meanings that equal a name, or a name up to " (" with a type of at
    most ten characters and no further bracket; the first such name (`ord`) wins, and all concepts of that name follow.

    Two equal joins instead of a nested loop over the disjunction. Each of their sides is made distinct first, so that the
    result is: it has a row for each abbreviation and each concept of its name, and isn't shuffled.
    """
    low = F.lower("concept_name")
    names = synonyms.select("concept_name", "ord", low.alias("k1"), F.split(low, r" \(").alias("parts"))
    short = names.where((F.size("parts") <= 2) & (F.length(F.element_at("parts", -1)) <= 10))
    keys = names.select("concept_name", "ord", F.col("k1").alias("k")).unionByName(short.select("concept_name", "ord", F.get("parts", F.lit(0)).alias("k")))
    first = keys.groupBy("k").agg(F.min_by("concept_name", "ord").alias("concept_name"))
    short_forms = abbr.select("abbreviation", "meaning").distinct().withColumn("k", F.lower("meaning"))
    concepts = synonyms.select("concept_name", "concept_id").distinct()
    return short_forms.join(first, "k").join(concepts, "concept_name", "left").select("abbreviation", "meaning", "concept_id", "concept_name")


def abbreviation_dictionary(abbr: DataFrame, min_length: int = 4) -> DataFrame:
    """section (any), mention, concept_id: of each abbreviation that is long enough the first row (`ord`)."""
    first = first_rows(abbr.where(F.length("abbreviation") >= min_length), ["abbreviation"], "ord")
    return first.select(F.lit("any").alias("section"), F.col("abbreviation").alias("mention"), "concept_id")


def edge_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names of source, destination and type, all from one table (concept_id, name)."""
    named = edges
    for c in ("src", "dst", "type"):
        named = named.join(names.select(F.col("concept_id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return named


def edges_in(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges with a source or a destination in the terminology: two left joins on distinct ids, no disjunctive join."""
    ids = terms.select("concept_id").distinct().withColumn("__in", F.lit(True))
    a, b = (ids.select(F.col("concept_id").alias(c), F.col("__in").alias(f"__{c}")) for c in ("src", "dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where(F.col("__src").isNotNull() | F.col("__dst").isNotNull()).drop("__src", "__dst")


def term_extensions(pairs: DataFrame, stop_words=T.STOP_WORDS) -> DataFrame:
    """general and specific ids and names, additional_word, where the specific name adds just one word that isn't a stop word
    to the general name and lacks none. pairs: src, src_name, dst, dst_name of Is-A edges."""
    words = lambda c: F.split(F.get(F.split(F.lower(c), r"\("), F.lit(0)), r"\s")
    stop = F.array(*map(F.lit, stop_words))
    more = lambda a, b: F.array_except(F.array_except(words(a), words(b)), stop)
    d = pairs.withColumn("more", more("src_name", "dst_name")).withColumn("less", more("dst_name", "src_name"))
    return d.where((F.size("more") == 1) & (F.size("less") == 0)).select(F.col("dst").alias("general_id"), F.col("dst_name").alias("general_name"), F.col("src").alias("specific_id"), F.col("src_name").alias("specific_name"), F.get("more", F.lit(0)).alias("additional_word"))


def unigrams(synonyms: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """concept_id, word, n: names of one word that the corpus has less often than the threshold."""
    one = synonyms.select("concept_id", F.lower(F.trim("concept_name")).alias("word")).where(~F.contains("word", F.lit(" ")) & (F.col("word") != ""))
    return one.join(counts, "word", "left").select("concept_id", "word", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < threshold).distinct()


def synonym_dictionary(synonyms: DataFrame, names: DataFrame, min_words: int = 2, max_words: int = 5) -> DataFrame:
    """section (any), mention, concept_id: processed names of the right length; a later name overwrites, full names last.

    synonyms, names: concept_id, concept_name, ord; names hold the fully specified ones.
    """
    both = synonyms.select("concept_id", "concept_name", F.lit(0).alias("part"), "ord").unionByName(names.select("concept_id", "concept_name", F.lit(1).alias("part"), "ord"))
    low = F.col("concept_name")
    fine = (F.length(low) >= 3) & ~F.contains(low, F.lit("machine translation")) & ~(F.contains(low, F.lit("]")) & (F.locate("[", low) > 6))
    # a generator keeps the name's long expression from being repeated in each condition
    m = both.where(fine).withColumn("mention", F.explode(F.array(T.process_term("concept_name")))).withColumn("n", F.size(F.split("mention", r"\s+")))
    m = m.where(F.col("n").between(min_words, max_words) & F.substring("mention", 1, 1).rlike(r"[\p{L}\p{N}]") & (F.length("mention") > 1))
    return m.groupBy("mention").agg(F.max_by("concept_id", F.struct("part", "ord")).alias("concept_id")).select(F.lit("any").alias("section"), "mention", "concept_id")


def concept_class(spans: DataFrame, procedures: DataFrame, bodies: DataFrame, findings: DataFrame) -> DataFrame:
    """Add `cls` by membership of the concept: proc before body before find; others go. The tables have concept_id."""
    out = spans
    for name, ids in (("proc", procedures), ("body", bodies), ("find", findings)):
        out = out.join(ids.select("concept_id").distinct().withColumn(f"__{name}", F.lit(name)), "concept_id", "left")
    return out.withColumn("cls", F.coalesce("__proc", "__body", "__find")).drop("__proc", "__body", "__find").where("cls is not null")


def specialise(spans: DataFrame, notes: DataFrame, extensions: DataFrame, max_words: int = 2, max_chars: int = 20, before: bool = True, after: bool = False) -> DataFrame:
    """Spans whose concept has an extension with its word before them (or behind them) take the specific concept.

    Up to max_words words within max_chars characters on a side, not reaching into the neighbouring span, are looked at; the
    first extension (`ord`) with a word among them wins, words before a span first; a word also counts capitalised or in
    capitals, left and right also as L, R, left-sided and right-sided. The span grows only over a word directly beside it.
    Other columns stay.
    """
    w = W.partitionBy("note_id").orderBy("start", "end", "ord")
    start, end, size = F.col("start"), F.col("end"), F.length("text")
    left = F.greatest(F.coalesce(F.lag("end").over(w) + 1, F.lit(0)), start - max_chars)
    s = spans.withColumns({"__left": left, "__next": F.lead("start").over(w)}).join(notes.select("note_id", "text"), "note_id")
    right = F.least(F.coalesce(F.col("__next") - 1, size - 1), end + max_chars)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    s = s.withColumns({"__before": F.when(start > F.col("__left"), T.slice_text("text", F.col("__left"), start)).otherwise(""), "__after": F.when(right > end, T.slice_text("text", end, right)).otherwise("")}).drop("text")
    s = s.withColumns({"__b": F.reverse(F.slice(F.reverse(words("__before")), 1, max_words)) if before else F.array().cast("array<string>"), "__a": F.slice(words("__after"), 1, max_words) if after else F.array().cast("array<string>")})
    a = F.col("additional_word")
    sides = F.when(a.isin("left", "right"), F.array(F.upper(F.substring(a, 1, 1)), F.concat(a, F.lit("-sided")))).otherwise(F.array().cast("array<string>"))
    e = extensions.select(F.col("general_id").alias("concept_id"), F.col("specific_id"), F.concat(F.array(a, F.initcap(a), F.upper(a)), sides).alias("forms"), F.col("ord").alias("e_ord"))
    hit = s.join(e, "concept_id").where(F.arrays_overlap("__b", "forms") | F.arrays_overlap("__a", "forms"))
    best = hit.groupBy("note_id", "ord").agg(F.min_by(F.struct("specific_id", "forms"), F.struct("e_ord", "specific_id")).alias("__hit"))
    found = s.join(best, ["note_id", "ord"], "left")
    is_form = lambda x: F.array_contains(F.col("__hit.forms"), x)
    # the first hit is the word directly before the span only if no earlier one is a hit
    ahead, behind = F.exists("__b", is_form), F.size("__b") - F.size(F.filter("__b", is_form))
    beside = ahead & is_form(F.element_at("__b", -1)) & (behind == F.size("__b") - 1)
    grown = ~ahead & is_form(F.get("__a", F.lit(0)))
    left_gap = F.length("__before") - F.length(F.regexp_replace("__before", r"\s+$", ""))
    right_gap = F.length("__after") - F.length(F.regexp_replace("__after", r"^\s+", ""))
    moved = {
        "start": F.when(beside, start - F.length(F.element_at("__b", -1)) - left_gap).otherwise(start).cast("int"),
        "end": F.when(grown, end + F.length(F.get("__a", F.lit(0))) + right_gap).otherwise(end).cast("int"),
        "concept_id": F.coalesce("__hit.specific_id", "concept_id"),
    }
    return found.withColumns(moved).drop("__left", "__next", "__before", "__after", "__b", "__a", "__hit")
