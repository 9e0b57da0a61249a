"""Whole runs of the sectioned dictionary: learn, prune, split by case, grow, limit; predict; store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionary as D
from . import sections as H
from .shared import cut_lineage


@dataclass
class Dictionaries:
    """entries: section, mention, concept_id, sections for lower-case text; cased: section, mention, concept_id for raw text."""

    entries: DataFrame
    cased: DataFrame

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.cased.write.mode("overwrite").parquet(f"{path}/cased")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionaries:
        return Dictionaries(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/cased"))


def lower_case(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", F.lower("text").alias("text"))


def _learned(notes: DataFrame, annotations: DataFrame, headers: tuple[str, ...], max_n: int, blacklist: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pruned keys without those that moved to upper case, the moved ones, and the annotations with their section."""
    from .spans import with_surface

    low = lower_case(notes)
    ranges = cut_lineage(H.section_headers(low, tuple(h.lower() for h in headers)))
    model = D.DictionaryModel(max_n=max_n, blacklist=blacklist).fit(low, annotations, ranges)
    entries = cut_lineage(model.entries)
    surfaces = with_surface(annotations, notes.select("note_id", "text"), "source_orig")
    cased = cut_lineage(D.uppercase_mentions(surfaces, entries, headers=headers))
    upper = cased.select(F.lower("mention").alias("mention")).distinct()
    placed = H.at_section(annotations, ranges).withColumnRenamed("header", "section")
    return entries.join(upper, "mention", "left_anti"), cased, placed


def train(notes: DataFrame, annotations: DataFrame, headers: tuple[str, ...], sources: list[DataFrame], names: DataFrame, blacklist: DataFrame, types: DataFrame, max_n: int = 5) -> Dictionaries:
    """Learn from the notes, prune on them, move upper-case keys, add the sources, replacements and permutations, limit
    any-section keys to the sections of their concept's type.

    annotations: a span table with ord and seen; sources: section, mention, concept_id, in the order they are added; names:
    concept_id, name (processed full names); types: concept_id, type. Steps that are read again are cut in the shared folder.
    """
    entries, cased, placed = _learned(notes, annotations, headers, max_n, blacklist)
    grown = D.add_external(entries.select("section", "mention", "concept_id"), sources, names, blacklist)
    return Dictionaries(D.limit_any(grown, types, H.allowed_sections(placed, types)), cased)


def build_full(notes: DataFrame, annotations: DataFrame, test_annotations: DataFrame, headers: tuple[str, ...], external: Dictionaries, types: DataFrame, max_n: int = 5) -> Dictionaries:
    """Learn from the notes, then add keys of a pre-built pair of dictionaries that are neither there nor mentions of the test
    annotations alone; both annotation tables carry `mention`."""
    entries, cased, placed = _learned(notes, annotations, headers, max_n)
    blocked = D.blocked_mentions(test_annotations, annotations)
    columns = ["section", "mention", "concept_id"]
    merged = D.merge_external(entries.select(columns), external.entries.select(columns), blocked)
    # a cased key is blocked by its lower-case mention
    upper = external.cased.select(columns).join(blocked.select(F.col("mention").alias("__m")), F.lower("mention") == F.col("__m"), "left_anti")
    none = blocked.where("false")
    return Dictionaries(D.limit_any(merged, types, H.allowed_sections(placed, types)), D.merge_external(cased.select(columns), upper, none))


def predict(notes: DataFrame, headers: tuple[str, ...], dictionaries: Dictionaries, abbreviations: DataFrame, extensions: DataFrame, max_n: int = 5) -> DataFrame:
    """Both passes over the notes: lower-case text with the entries; raw text with abbreviations, the cased keys and the fixed
    case-sensitive ones, of which the later overwrites the same key; overlaps resolved, concepts specialised.

    abbreviations: section, mention, concept_id.
    """
    own = lambda df, rank: df.select("section", "mention", "concept_id", F.when(F.col("section") != D.ANY, F.array("section")).alias("sections"), F.lit(rank).alias("rank"))
    fixed = D.case_sensitive_entries(notes.sparkSession).withColumn("rank", F.lit(2))
    ranked = own(abbreviations, 0).unionByName(own(dictionaries.cased, 1)).unionByName(fixed)
    key = F.coalesce(F.array_join("sections", "|"), F.lit(D.ANY)).alias("__key")
    raw = ranked.groupBy(key, "mention").agg(F.max_by(F.struct("section", "concept_id", "sections"), "rank").alias("x")).select("mention", "x.*")
    low = lower_case(notes)
    return D.make_predictions(notes, H.section_headers(low, tuple(h.lower() for h in headers)), H.section_headers(notes, headers), dictionaries.entries, raw, extensions, max_n)
