"""Dictionaries learned from annotated notes, matched against others: tokens, n-grams, majorities, precision pruning."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import lexicon, tokens
from . import spans as S
from .sections import CLINICAL_HEADERS
from .shared import cut_lineage
from .tokens import ngram_table

# Mentions that are never learned, the any-section key, thresholds, case-sensitive entries.
BLACKLIST = ("other", "negative", "follow up", "mild", "normal", "inr", "changes", "change", "iv")
ANY = "any"
SECTION_FRACTION, ANY_FRACTION = 0.2, 0.3
COMMON_WORD_COUNT = 2000
# mentions that count in this spelling only, their sections (none: any) and concepts
CASE_SENSITIVE = (
    (("other", "Pertinent Results:"), "K", 312468003),
    (None, "T", 105723007),
    (("other", "Pertinent Results:"), "Mg", 271285000),
    (("Physical Exam:",), "RA", 722742002),
    (("other", "Pertinent Results:"), "Plt", 61928009),
    (("other", "Pertinent Results:"), "MR", 48724000),
)


def token_table(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """note_id, ord (from 0), tok, start, end of each token; one narrow pass, no shuffle."""
    return tokens.token_table(notes, keep).drop("next_end")


def majority(counted: DataFrame, keys: list[str], value: str = "concept_id") -> DataFrame:
    """Of rows (keys, value, n, first_seen): per key the value with most n, ties to the first seen; with n and total."""
    w = W.partitionBy(*keys)
    ranked = counted.withColumn("total", F.sum("n").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("n"), "first_seen", value)))
    return ranked.where("__r = 1").drop("__r")


def counted_terms(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """term, concept_id, n, first_seen of the normalised surfaces; `seen` orders the annotations. Annotations that carry `term` keep it;
    with `n` too, a row stands for that many, and each row is shuffled once, by its term."""
    named = annotations if "term" in annotations.columns else S.with_surface(annotations, notes).withColumn("term", T.normalize_term("surface"))
    named = named.where("term <> ''")
    if "n" in named.columns:
        return named.repartition("term").groupBy("term", "concept_id").agg(F.sum("n").alias("n"), F.min("seen").alias("first_seen"))
    return named.groupBy("term", "concept_id").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"))


def most_common_concept(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """term, concept_id: the majority concept of each normalised surface."""
    return majority_terms(counted_terms(annotations, notes)).select("term", "concept_id")


def majority_terms(counted: DataFrame) -> DataFrame:
    """term, concept_id, n of counted_terms(): the concept with most annotations and how many it has."""
    return majority(counted, ["term"]).select("term", "concept_id", "n")


def terms_of_concept(counted: DataFrame) -> DataFrame:
    """concept_id, terms in the order they were first seen."""
    return counted.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "term"))).alias("t")).select("concept_id", F.transform("t", lambda x: x["term"]).alias("terms"))


def concepts_of_term(counted: DataFrame) -> DataFrame:
    """term, concepts in the order they were first seen."""
    return counted.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("first_seen", "concept_id"))).alias("t")).select("term", F.transform("t", lambda x: x["concept_id"]).alias("concepts"))


def linker_dictionary(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """key, concept_id: the majority concept of each surface reduced to its letters."""
    named = S.with_surface(annotations, notes).withColumn("key", T.letters_only("surface"))
    counted = named.groupBy("key", "concept_id").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"))
    return majority(counted, ["key"]).select("key", "concept_id")


def linker_keys(counted: DataFrame) -> DataFrame:
    """linker_dictionary() of counted_terms(): a term has the letters of its surfaces, so these need not be read again."""
    by_key = counted.groupBy(T.letters_only("term").alias("key"), "concept_id").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    return majority(by_key, ["key"]).select("key", "concept_id")


def term_hits(notes: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    """note_id, start, end, concept_id, term, ord: every run of up to max_n tokens that is a term."""
    return S.with_order(_term_hits(notes, dictionary, max_n), "start", "end")


def _term_hits(notes: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    terms = dictionary.where(F.size(F.split("term", " ")) <= max_n).select("term", "concept_id")
    return lexicon.match_terms(notes, terms).select("note_id", "start", "end", "concept_id", "term")


def predict_with_dictionary(notes: DataFrame, dictionary: DataFrame, max_n: int, ignored: DataFrame | None = None, prefer_longer: bool = True, named: bool = True) -> DataFrame:
    """Term hits outside ignored header spans (note_id, start, end), longest first. dictionary: term, concept_id, and n where it is
    known how often a term was learned. not named: without `term`."""
    if ignored is None and prefer_longer:
        if "n" in dictionary.columns:
            return lexicon.longest_terms(notes, dictionary.where(F.size(F.split("term", " ")) <= max_n).select("concept_id", "term", "n"), "n", named=named)
        found = _term_hits(notes, dictionary, max_n)
        return S.longest_wins(found if named else found.drop("term"))
    hits = term_hits(notes, dictionary, max_n)
    hits = hits if named else hits.drop("term")
    if ignored is not None:
        hits = S.overlapping(hits, ignored, S.inclusive_overlap, keep=False)
    return S.longest_wins(hits) if prefer_longer else hits


def alternate_terms(notes: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    """alternation_scan() of term_hits() by the order of terms, without a row for each hit. dictionary: term, concept_id, n."""

    def choose(note, start, end, order, column):
        return S.leftmost_of(note, start, end, pc.rank(column("term"), tiebreaker="dense").to_numpy()), []

    return _chosen(notes, dictionary, max_n, choose)


def settled_terms(notes: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    """remove_overlaps() of term_hits(), likewise; dictionary: term, concept_id, n, any_section."""

    def choose(note, start, end, order, column):
        return np.array(S.swept(start, end, S.chain_bounds(note, start, end, True), column("any_section")), np.int64), []

    return _chosen(notes, dictionary, max_n, choose)


def first_term_overlaps(notes: DataFrame, dictionary: DataFrame, max_n: int) -> DataFrame:
    """first_overlaps() of term_hits(), likewise."""

    def choose(note, start, end, order, column):
        one, other = S.first_pairs(note, start, end)
        return one, [start[other], end[other]]

    found = _chosen(notes, dictionary, max_n, choose, False, ("start2", "end2"))
    return found.select("note_id", F.col("start").alias("start1"), F.col("end").alias("end1"), "start2", "end2")


def _chosen(notes: DataFrame, dictionary: DataFrame, max_n: int, choose, named: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    terms = dictionary.where(F.size(F.split("term", " ")) <= max_n)
    return lexicon.chosen_terms(notes, terms, "n", choose, named=named, more=more)


def static_ratio(annotations: DataFrame, notes: DataFrame, max_n: int, threshold: float = 0.25) -> DataFrame:
    """term, n_gold, n_hits, ratio: gold mentions of a term against dictionary hits of it; ratio above the threshold."""
    counted = counted_terms(annotations, notes)
    gold = counted.groupBy("term").agg(F.sum("n").alias("n_gold"))
    hits = predict_with_dictionary(notes, majority(counted, ["term"]).select("term", "concept_id"), max_n, prefer_longer=False).groupBy("term").agg(F.count("*").alias("n_hits"))
    return gold.join(hits, "term").withColumn("ratio", F.col("n_gold") / F.col("n_hits")).where(F.col("ratio") > threshold)


def corpus_word_count(notes: DataFrame) -> DataFrame:
    """word, n: white-space words of the lower-cased texts."""
    return notes.select(F.explode(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def common_words(counts: DataFrame, threshold: int = COMMON_WORD_COUNT) -> DataFrame:
    """word: words above the threshold, and the fixed blacklist."""
    fixed = counts.sparkSession.createDataFrame([(w,) for w in BLACKLIST], "word string")
    return counts.where(F.col("n") > threshold).select("word").unionByName(fixed).distinct()


def section_counts(annotations: DataFrame, notes: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """section, mention, concept_id, n, first_seen; each annotation counts for its section and for any.

    annotations carry `section` (null: any alone) and `seen`. Mentions of one character and blacklisted ones don't count.
    """
    named = S.with_surface(annotations, notes).withColumn("mention", T.mention_key("surface")).where(F.length("mention") > 1)
    named = named.join(blacklist.select(F.col("word").alias("mention")), "mention", "left_anti") if blacklist is not None else named.where(~F.col("mention").isin(*BLACKLIST))
    sections = F.array(F.coalesce("section", F.lit(ANY)), F.lit(ANY))
    return named.select("mention", "concept_id", "seen", F.explode(sections).alias("section")).groupBy("section", "mention", "concept_id").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"))


def section_dictionary(annotations: DataFrame, notes: DataFrame, min_count: int = 1, blacklist: DataFrame | None = None) -> DataFrame:
    """section, mention, concept_id by majority; rare keys go, and any-section keys whose majority holds less than half."""
    return kept_majorities(majority(section_counts(annotations, notes, blacklist), ["section", "mention"]), min_count)


def kept_majorities(top: DataFrame, min_count: int = 1) -> DataFrame:
    """section, mention, concept_id of majority() that are frequent enough; any-section keys need half of their annotations."""
    return top.where((F.col("total") >= min_count) & ((F.col("section") != ANY) | (F.col("n") / F.col("total") >= 0.5))).select("section", "mention", "concept_id")


def match_sections(notes: DataFrame, headers: DataFrame, dictionary: DataFrame, max_n: int, skip_prefix: int = 100) -> DataFrame:
    """Every n-gram that is a mention of its section, else of any; note_id, start, end, concept_id, section, any_section, ord.

    headers: note_id, start, end, header (ranges that don't overlap). Hits in the first skip_prefix characters, before the
    first header, or under medication, service and birth date headers don't count.
    """
    from .sections import at_section, excluded_section

    grams = ngram_table(notes, max_n).where(F.col("start") >= skip_prefix)
    placed = at_section(grams, headers).where(F.col("header").isNotNull() & ~excluded_section(F.col("header")))
    own = dictionary.where(F.col("section") != ANY).select(F.col("section").alias("header"), F.col("mention").alias("gram"), F.col("concept_id").alias("own_concept"))
    any_ = dictionary.where(F.col("section") == ANY).select(F.col("mention").alias("gram"), F.col("concept_id").alias("any_concept"))
    found = placed.join(own, ["header", "gram"], "left").join(any_, "gram", "left")
    found = found.where(F.col("own_concept").isNotNull() | F.col("any_concept").isNotNull())
    hits = found.select("note_id", "start", "end", F.coalesce("own_concept", "any_concept").alias("concept_id"), F.when(F.col("own_concept").isNotNull(), F.col("header")).otherwise(ANY).alias("section"), F.col("gram").alias("dict_entry"))
    return S.with_order(hits.withColumn("any_section", F.col("section") == ANY), "start", "end")


def predict_sections(notes: DataFrame, headers: DataFrame, dictionary: DataFrame, max_n: int, skip_prefix: int = 100) -> DataFrame:
    """match_sections() with overlaps resolved."""
    return S.remove_overlaps(match_sections(notes, headers, dictionary, max_n, skip_prefix))


def join_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two passes over the same notes as one: hits of both with overlaps resolved; at ties the first pass comes first."""
    both = first.drop("ord").withColumn("__pass", F.lit(0)).unionByName(second.drop("ord").withColumn("__pass", F.lit(1)), allowMissingColumns=True)
    return S.remove_overlaps(S.with_order(both, "start", "end", "__pass").drop("__pass"))


def case_sensitive_entries(spark) -> DataFrame:
    """The fixed entries that count in this spelling only: section, mention, concept_id, sections."""
    rows = [(sections[0] if sections else ANY, mention, concept, list(sections) if sections else None) for sections, mention, concept in CASE_SENSITIVE]
    return spark.createDataFrame(rows, "section string, mention string, concept_id long, sections array<string>")


# --- pruning by training notes ---------------------------------------------------------------------------------------
def score_hits(hits: DataFrame, gold: DataFrame, reach_last: bool = True) -> DataFrame:
    """Add `score` to hits: 1 if the gold span at the cursor (else the next one) has the concept and the same offsets, or the
    mention has several words; else -1.

    The cursor is the last gold span that starts at the hit's start or before. reach_last=False leaves each note's last gold
    span out, as the published procedure does.
    """
    w = W.partitionBy("note_id").orderBy("start", "end", "ord")
    ranked = gold.select("note_id", "start", "end", "concept_id", "ord").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("note_id")))
    last = F.col("n") - (1 if reach_last else 2)
    ranked = ranked.where(F.col("i") <= F.greatest(last, F.lit(0)))
    following = ranked.withColumns({f"next_{c}": F.lead(c).over(W.partitionBy("note_id").orderBy("i")) for c in ("start", "end", "concept_id")})
    # as-of: mark gold and hits in one ordered stream and carry the last gold span forward
    g = F.struct("start", "end", "concept_id", "next_start", "next_end", "next_concept_id")
    stream = following.select("note_id", "start", F.lit(0).alias("kind"), F.col("i").alias("at"), g.alias("g"), F.lit(None).cast(hits.schema).alias("h"))
    stream = stream.unionByName(hits.select("note_id", "start", F.lit(1).alias("kind"), F.col("ord").alias("at"), F.lit(None).cast(stream.schema["g"].dataType).alias("g"), F.struct(*hits.columns).alias("h")))
    over = W.partitionBy("note_id").orderBy("start", "kind", "at").rowsBetween(W.unboundedPreceding, 0)
    held = stream.withColumn("g", F.last("g", ignorenulls=True).over(over)).withColumn("first", F.first("g", ignorenulls=True).over(W.partitionBy("note_id").orderBy("start", "kind", "at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    held = held.where("kind = 1").withColumn("g", F.coalesce("g", "first"))

    def one(start: Column, end: Column, concept: Column) -> Column:
        same = (concept == F.col("h.concept_id")) & (((start == F.col("h.start")) & (end == F.col("h.end"))) | F.contains("h.dict_entry", F.lit(" ")))
        return F.when(start.isNull(), 0).when(start > F.col("h.start"), -1).when(end < F.col("h.start"), 0).when(same, 1).otherwise(-1)

    here, then = one(F.col("g.start"), F.col("g.end"), F.col("g.concept_id")), one(F.col("g.next_start"), F.col("g.next_end"), F.col("g.next_concept_id"))
    score = F.when(here != 0, here).when(then != 0, then).otherwise(-1)
    return held.select("h.*", score.alias("score"))


def naive_remove(correct: Column, incorrect: Column, section: Column, doubled: Column | None = None) -> Column:
    """Whether a key errs too often: fewer correct hits than a share of the wrong ones, all of them if just one is correct."""
    share = F.when(section == ANY, ANY_FRACTION).otherwise(SECTION_FRACTION)
    if doubled is not None:
        share = F.when(doubled, share * 2).otherwise(share)
    return correct < F.when(correct == 1, F.lit(1.0)).otherwise(share) * incorrect


def key_scores(scored: DataFrame, by_note: bool = True) -> DataFrame:
    """section, dict_entry, n_correct, n_incorrect; by note a key counts at most one of each per note."""
    count = (lambda v: F.count_distinct(F.when(F.col("score") == v, F.col("note_id")))) if by_note else (lambda v: F.count_if(F.col("score") == v))
    return scored.groupBy("section", "dict_entry").agg(count(1).alias("n_correct"), count(-1).alias("n_incorrect"))


def remove_bad_keys(dictionary: DataFrame, scores: DataFrame) -> DataFrame:
    bad = scores.where(naive_remove(F.col("n_correct"), F.col("n_incorrect"), F.col("section"))).select("section", F.col("dict_entry").alias("mention"))
    return dictionary.join(bad, ["section", "mention"], "left_anti")


def greedy_keys(scores: DataFrame, annotation_counts: DataFrame) -> DataFrame:
    """concept_id, section, dict_entry, bad: a concept's keys, by falling ratio of correct to incorrect, are kept while their
    ratio beats that of all kept so far (missed annotations count as incorrect) or naive_remove() would keep them; from the
    fourth key on its share is doubled. scores: concept_id and key counts; annotation_counts: concept_id, n.

    A concept's keys are folded in order with array functions; the state holds the sums of the keys kept.
    """
    ratio = F.col("n_correct") / (F.col("n_incorrect") + 0.01)
    key = F.struct((-ratio).alias("by"), "section", "dict_entry", "n_correct", "n_incorrect")
    keys = scores.join(annotation_counts, "concept_id").groupBy("concept_id", "n").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    start = F.struct(F.lit(0).cast("long").alias("right"), F.lit(0).cast("long").alias("wrong"), F.array().cast("array<boolean>").alias("bad"))

    def step(state: Column, k: Column) -> Column:
        beats = state["right"] / (state["wrong"] + F.col("n")) < -k["by"]
        keep = beats | ~naive_remove(k["n_correct"], k["n_incorrect"], k["section"], doubled=F.size(state["bad"]) > 2)
        counted = lambda c: F.when(keep, c).otherwise(F.lit(0))
        return F.struct(
            (state["right"] + counted(k["n_correct"])).alias("right"),
            (state["wrong"] + counted(k["n_incorrect"])).alias("wrong"),
            F.concat(state["bad"], F.array(~keep)).alias("bad"),
        )

    folded = keys.select("concept_id", "keys", F.aggregate("keys", start, step)["bad"].alias("bad"))
    each = folded.select("concept_id", F.explode(F.arrays_zip("keys", "bad")).alias("x"))
    return each.select("concept_id", F.col("x.keys.section").alias("section"), F.col("x.keys.dict_entry").alias("dict_entry"), F.col("x.bad").alias("bad"))


# --- growing a dictionary --------------------------------------------------------------------------------------------
def cond_update(dictionary: DataFrame, more: DataFrame, names: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Add keys that aren't blacklisted; a key that is there is overwritten only where the mention is the new concept's name.

    dictionary, more: section, mention, concept_id with one row per key; names: concept_id, name.
    """
    fresh = more.join(blacklist.select(F.col("word").alias("mention")), "mention", "left_anti").join(names, "concept_id", "left")
    fresh = fresh.select("section", "mention", F.col("concept_id").alias("new"), (F.col("name") == F.col("mention")).alias("named"))
    both = dictionary.join(fresh, ["section", "mention"], "full_outer")
    return both.select("section", "mention", F.when(F.col("concept_id").isNull() | F.coalesce("named", F.lit(False)), F.coalesce("new", "concept_id")).otherwise(F.col("concept_id")).alias("concept_id"))


def word_replacements(dictionary: DataFrame) -> DataFrame:
    """section, mention, concept_id with one rule of replacement applied; of equal results the later key and rule stays.
    `ord` orders the keys."""
    rules = F.array(*(F.struct(F.lit(i).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(T.REPLACEMENTS)))
    made = dictionary.select("section", "mention", "concept_id", "ord", F.explode(rules).alias("x")).where(F.contains("mention", F.col("x.a")))
    made = made.select("section", F.replace("mention", F.col("x.a"), F.col("x.b")).alias("mention"), "concept_id", F.struct("ord", "x.r").alias("at"))
    return made.groupBy("section", "mention").agg(F.max_by("concept_id", "at").alias("concept_id"))


def word_permutations(dictionary: DataFrame, blacklist: DataFrame) -> DataFrame:
    """section, mention, concept_id: reordered mentions of three or four words that aren't keys yet.

    "x of y" turns round; "x of y z" and "x y of z" likewise; others take all orders if no word is blacklisted. Of equal
    results the later key (`ord`) stays.
    """
    keyed = dictionary.withColumn("w", F.split(F.trim("mention"), " +")).where(F.size("w").isin(3, 4))
    bad = keyed.select("section", "mention", F.explode("w").alias("word")).join(blacklist, "word", "left_semi").select("section", "mention").distinct().withColumn("bad", F.lit(True))
    word = lambda i: F.col("w")[i]
    text = lambda order: F.concat_ws(" ", *(word(i) for i in order))
    every = lambda n: F.array(*(text(p) for p in permutations(range(n))))
    none = F.array().cast("array<string>")
    three, four = F.size("w") == 3, F.size("w") == 4
    clean = F.coalesce("bad", F.lit(False)) == F.lit(False)
    made = F.when(three & (word(1) == "of"), F.array(text((2, 0)))).when(four & (word(1) == "of"), F.array(text((2, 3, 0)))).when(four & (word(2) == "of"), F.array(text((3, 0, 1)), text((0, 3, 1)))).when(three & clean, every(3)).when(four & clean, every(4)).otherwise(none)
    found = keyed.join(bad, ["section", "mention"], "left").select("section", F.explode(made).alias("mention"), "concept_id", "ord")
    return found.groupBy("section", "mention").agg(F.max_by("concept_id", "ord").alias("concept_id")).join(dictionary.select("section", "mention"), ["section", "mention"], "left_anti")


def cased_section(section: Column, headers: tuple[str, ...]) -> Column:
    """The spelling that a lower-case section has in raw text: its header's; other and any stay, unknown ones become any."""
    known = F.create_map(*(F.lit(x) for h in headers for x in (h.lower() + ":", h + ":")))
    return F.when(section.isin("other", ANY), section).otherwise(F.coalesce(F.try_element_at(known, section), F.lit(ANY)))


def uppercase_mentions(annotations: DataFrame, dictionary: DataFrame, share: float = 0.99, headers: tuple[str, ...] = CLINICAL_HEADERS) -> DataFrame:
    """Keys whose training surfaces (source_orig, by mention) are upper case in more than `share`; unseen ones don't move."""
    upper = annotations.groupBy(T.mention_key("source_orig").alias("mention")).agg(F.avg((F.col("source_orig") == F.upper("source_orig")).cast("int")).alias("u")).where(F.col("u") > share)
    moved = dictionary.join(upper.select("mention"), "mention", "left_semi")
    return moved.select(cased_section(F.col("section"), headers).alias("section"), F.upper("mention").alias("mention"), "concept_id")


def blocked_mentions(test: DataFrame, train: DataFrame) -> DataFrame:
    """mention: those of the test annotations that the training ones lack, which a pre-built dictionary must not know."""
    return test.select("mention").distinct().join(train.select("mention").distinct(), "mention", "left_anti")


def merge_external(dictionary: DataFrame, external: DataFrame, blocked: DataFrame) -> DataFrame:
    """Add external keys that are neither there nor blocked."""
    more = external.join(blocked, "mention", "left_anti").join(dictionary.select("section", "mention"), ["section", "mention"], "left_anti")
    return dictionary.unionByName(more.select(dictionary.columns))


def limit_any(dictionary: DataFrame, concept_types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Add `sections` to each key: its own, or for `any` those its concept's type was seen in (null: any section)."""
    typed = dictionary.join(concept_types, "concept_id", "left").join(allowed, "type", "left")
    return typed.select("section", "mention", "concept_id", F.when(F.col("section") == ANY, F.col("sections")).otherwise(F.array("section")).alias("sections"))


def confidence(hits: DataFrame, scored: DataFrame, tau: float = 0.3) -> DataFrame:
    """Add confidence p / (p + tau * m) of a hit's key from its training scores; 1 for a key never scored. Not rounded."""
    p, m = F.col("n_correct"), F.col("n_incorrect")
    value = F.when(p.isNull(), F.lit(1.0)).when(p + tau * m > 0, p / (p + tau * m)).otherwise(0.0)
    return hits.join(key_scores(scored, by_note=False), ["section", "dict_entry"], "left").withColumn("confidence", value).drop("n_correct", "n_incorrect")


def precision_view(hits: DataFrame, scored: DataFrame, digits: int = 2) -> DataFrame:
    """Add score, the share of correct ones among a key's training scores (1 for a key without any), rounded, and
    seen_in_train. Keys are looked up in lower case and trimmed, then as they are."""
    history = key_scores(scored, by_note=False).select("section", "dict_entry", F.bround(F.try_divide(F.col("n_correct"), F.col("n_correct") + F.col("n_incorrect")), digits).alias("p"))
    clean = lambda c: F.trim(F.lower(c))
    near = history.select(F.col("section").alias("__s"), F.col("dict_entry").alias("__e"), F.col("p").alias("__near"))
    own = hits.withColumns({"__s": clean("section"), "__e": clean("dict_entry")}).join(near, ["__s", "__e"], "left").drop("__s", "__e")
    found = own.join(history, ["section", "dict_entry"], "left").withColumn("__p", F.coalesce("__near", "p"))
    return found.withColumns({"score": F.coalesce("__p", F.lit(1.0)), "seen_in_train": F.col("__p").isNotNull()}).drop("__p", "__near", "p")


class DictionaryModel:
    """fit() learns a section dictionary and prunes it on its own notes; transform() predicts spans of other notes."""

    def __init__(self, max_n: int = 5, min_count: int = 1, prune: bool = True, blacklist: DataFrame | None = None):
        self.max_n, self.min_count, self.prune, self.blacklist = max_n, min_count, prune, blacklist
        self.entries: DataFrame | None = None

    def fit(self, notes: DataFrame, annotations: DataFrame, headers: DataFrame) -> DictionaryModel:
        """annotations: a span table with `ord` and `seen`."""
        from .sections import at_section

        placed = at_section(annotations, headers).withColumnRenamed("header", "section")
        self.entries = section_dictionary(placed, notes, self.min_count, self.blacklist)
        if self.prune:
            self.entries = cut_lineage(self.entries)  # read three times below
            hits = match_sections(notes, headers, self.entries, self.max_n)
            self.entries = remove_bad_keys(self.entries, key_scores(score_hits(hits, annotations)))
        return self

    def transform(self, notes: DataFrame, headers: DataFrame) -> DataFrame:
        return predict_sections(notes, headers, self.entries, self.max_n)

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> DictionaryModel:
        self.entries = spark.read.parquet(path)
        return self


# --- matching by pattern ---------------------------------------------------------------------------------------------
def annotate(notes: DataFrame, headers: DataFrame, dictionary: DataFrame, max_n: int | None = None, keep_overlaps: bool = False, skip_prefix: int = 100, case_sensitive: bool = False) -> DataFrame:
    """Matches of section mentions as patterns: note_id, start, end, concept_id, section, dict_entry, any_section, ord.

    dictionary: section, mention, concept_id and optionally sections (an array; null means any). A trie over the lexicon's
    tokens finds the candidates in one narrow pass a shard, and the text decides there (see lexicon.match_mentions).
    A match must stand at word boundaries, not in the first skip_prefix characters, not in a header line (unless overlaps
    are kept), nor under an excluded header or before the first one. A key counts where its section contains the header's
    name, equals it, or is any. keep_overlaps leaves overlaps unresolved.
    """
    from .sections import at_section, excluded_section

    d = dictionary if "sections" in dictionary.columns else dictionary.withColumn("sections", F.when(F.col("section") != ANY, F.array("section")))
    found = lexicon.match_mentions(notes, d.select("section", "sections", "mention", "concept_id"), max_n, skip_prefix, case_sensitive)
    if not keep_overlaps:
        found = found.where(~F.col("in_header"))
    flat = found.select("note_id", "start", "end", "concept_id", "section", "sections", F.col("mention").alias("dict_entry"))
    placed = at_section(flat, headers).where(F.col("header").isNotNull() & ~excluded_section(F.col("header")))
    fits = F.col("sections").isNull() | F.exists("sections", lambda s: F.contains(s, F.col("header")))
    hits = placed.where(fits).withColumn("any_section", F.col("sections").isNull() | (F.size("sections") > 1)).drop("header", "sections")
    ordered = S.with_order(hits, "start", "end", "dict_entry", "section")
    return ordered if keep_overlaps else S.remove_overlaps(ordered)


def make_predictions(notes: DataFrame, headers: DataFrame, raw_headers: DataFrame, dictionary: DataFrame, cased: DataFrame, extensions: DataFrame, max_n: int) -> DataFrame:
    """Both passes as one span table: lower-case text with the dictionary, raw text with case-sensitive entries; overlaps
    resolved, concepts specialised by the words before them."""
    from .terminology import specialise

    low = annotate(notes, headers, dictionary, max_n)
    raw = annotate(notes, raw_headers, cased, max_n, case_sensitive=True)
    return specialise(join_predictions(low, raw), notes.select("note_id", "text"), extensions)


def add_external(dictionary: DataFrame, sources: list[DataFrame], names: DataFrame, blacklist: DataFrame) -> DataFrame:
    """cond_update() with each source, then with word replacements, then with permutations of what is there by then."""
    for more in sources:
        dictionary = cond_update(dictionary, more, names, blacklist)
    numbered = lambda d: d.withColumn("ord", F.struct("section", "mention"))  # noqa: E731  # any fixed order of keys
    dictionary = cut_lineage(dictionary)
    dictionary = cut_lineage(cond_update(dictionary, word_replacements(numbered(dictionary)), names, blacklist))
    return cond_update(dictionary, word_permutations(numbered(dictionary), blacklist), names, blacklist)
