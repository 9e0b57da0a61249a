"""Sections of notes: header positions, as-of lookup, ignored and cut sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import spans as S

# Header names.
CLINICAL_HEADERS = ("Allergies", "History of Present Illness", "Family History", "Name", "Major Surgical or Invasive Procedure", "Admission Date", "Discharge Disposition", "Past Medical History", "Attending", "Service", "Date of Birth", "Discharge Instructions", "Discharge Condition", "Chief Complaint", "Physical Exam", "Pertinent Results", "Discharge Medications", "Social History", "Followup Instructions", "Medications on Admission", "Discharge Diagnosis")
IGNORED_HEADERS = ("medications on admission:", "___ on admission:", "discharge medications:")


def excluded_section(header: Column) -> Column:
    low = F.lower(header)
    return F.contains(low, F.lit("medication")) | F.contains(low, F.lit("service")) | F.contains(low, F.lit("date of birth"))


def named_headers(notes: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """note_id, pos, header: the first place of each `header:` in a note. The names are a short literal list."""
    found = F.transform(F.array(*(F.lit(h + ":") for h in headers)), lambda h: F.struct(F.instr(F.col("text"), h).alias("at"), h.alias("header")))
    return notes.select("note_id", F.explode(F.filter(found, lambda x: x["at"] > 0)).alias("x")).select("note_id", (F.col("x.at") - 1).alias("pos"), "x.header")


def line_headers(notes: DataFrame) -> DataFrame:
    """note_id, pos, header from the lines of a note.

    A line that ends with a colon before a blank line is a header at its own place. A line of - = _ : alone, behind a line
    that isn't blank, makes the last line that isn't blank a header, unless that one is a header itself.
    """
    w = W.partitionBy("note_id").orderBy("i")
    lines = notes.select("note_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("pos", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    lines = lines.withColumn("l", F.trim("line")).withColumn("next", F.lead(F.trim("line")).over(w)).withColumn("before", F.lag(F.trim("line")).over(w))
    titled = F.col("l").endswith(":") & (F.col("next") == "")
    full = lines.where("l <> ''").withColumn("titled", titled)
    rule = F.col("l").rlike("^[-=_:]+$") & ~F.col("titled")
    # a rule below a header changes nothing, not even that the line before was a header
    full = full.withColumn("state", F.when(F.col("titled"), True).when(rule, F.lit(None)).otherwise(F.lit(False)))
    full = full.withColumn("after_title", F.coalesce(F.last("state", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))).withColumn("last_pos", F.lag("pos").over(w))
    own = full.where("titled").select("note_id", "pos", F.col("l").alias("header"))
    under = full.where(rule & ~F.col("after_title") & (F.col("before") != "") & F.col("last_pos").isNotNull()).select("note_id", F.col("last_pos").alias("pos"), F.col("before").alias("header"))
    return own.unionByName(under)


def section_headers(notes: DataFrame, headers: tuple[str, ...] = CLINICAL_HEADERS, lines: bool = True) -> DataFrame:
    """note_id, start, end, header: ranges from each header to the next one or the text's end; a line's header wins at a
    place. Names outside `headers` are called other; all others end with a colon."""
    found = named_headers(notes, headers).withColumn("rank", F.lit(0))
    if lines:
        found = found.unionByName(line_headers(notes).withColumn("rank", F.lit(1)))
    found = found.groupBy("note_id", "pos").agg(F.max_by("header", "rank").alias("header"))
    known = F.col("header").isin(*headers) | F.expr("substring(header, 1, length(header) - 1)").isin(*headers)
    named = F.when(~known, "other").when(F.col("header").endswith(":"), F.col("header")).otherwise(F.concat("header", F.lit(":")))
    w = W.partitionBy("note_id").orderBy("pos")
    sized = found.join(notes.select("note_id", F.length("text").alias("size")), "note_id")
    return sized.select("note_id", F.col("pos").cast("int").alias("start"), F.lead("pos", 1).over(w).alias("next"), "size", named.alias("header")).select("note_id", "start", F.coalesce("next", "size").cast("int").alias("end"), "header")


def at_section(spans: DataFrame, headers: DataFrame) -> DataFrame:
    """Add `header`: that of the last range which starts at the span's start or before; null before the first.

    An as-of lookup in one pass: headers and spans go in one stream by position, and the last header is carried forward.
    """
    tagged = headers.select("note_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), "header", F.lit(None).cast(spans.schema).alias("__s"))
    stream = tagged.unionByName(spans.select("note_id", F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("header"), F.struct(*spans.columns).alias("__s")))
    over = W.partitionBy("note_id").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    return stream.withColumn("header", F.last("header", ignorenulls=True).over(over)).where("__kind = 1").select("__s.*", "header")


def first_containing(spans: DataFrame, headers: DataFrame) -> DataFrame:
    """Add `header`: that of the first range with start <= span start <= end (the end counts); null without one."""
    pairs = S.overlap_join(spans.select("note_id", "ord", "start", F.col("start").alias("end")), headers, S.inclusive_overlap)
    first = pairs.groupBy(F.col("l_note_id").alias("note_id"), F.col("l_ord").alias("ord")).agg(F.min_by("r_header", "r_start").alias("header"))
    return spans.join(first, ["note_id", "ord"], "left")


def true_header_spans(notes: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """note_id, start, end, header: first places of lower-case headers after line feeds became spaces, to the next one."""
    low = notes.select("note_id", F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")).alias("text"))
    found = F.transform(F.array(*map(F.lit, headers)), lambda h: F.struct(F.instr(F.col("text"), h).alias("at"), h.alias("header")))
    flat = low.select("note_id", F.length("text").alias("size"), F.explode(F.filter(found, lambda x: x["at"] > 0)).alias("x"))
    w = W.partitionBy("note_id").orderBy("x.at", "x.header")
    return flat.select("note_id", (F.col("x.at") - 1).alias("start"), F.coalesce(F.lead(F.col("x.at")).over(w) - 1, F.col("size")).cast("int").alias("end"), F.col("x.header").alias("header"))


def drop_sections(spans: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Spans whose header is none of the names; those without a header stay."""
    return spans.where(F.col("header").isNull() | ~F.col("header").isin(*names))


def outside_headers(spans: DataFrame, header_spans: DataFrame) -> DataFrame:
    """Spans that touch no header span."""
    return S.overlapping(spans, header_spans, S.inclusive_overlap, keep=False)


def mask_headers(spans: DataFrame, header_texts: DataFrame) -> DataFrame:
    """Spans not contained in any of the given ranges."""
    return S.overlapping(spans, header_texts, lambda s1, e1, s2, e2: (s2 <= s1) & (e1 <= e2), keep=False)


def cut_sections(notes: DataFrame, spans: DataFrame, headers: tuple[str, ...], cut: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Cut the named sections out, one after another; spans behind a cut move left, spans that begin in it go, and spans
    that reach into it stay as they are. A section runs to the next header or the text's end."""
    for name in cut:
        ranges = true_header_spans(notes, headers).where(F.col("header") == name).select("note_id", F.col("start").alias("__a"), F.col("end").alias("__b"))
        notes = notes.join(ranges, "note_id", "left")
        left, right = F.expr("substring(text, 1, __a)"), F.expr("substring(text, __b + 1, length(text))")
        notes = notes.withColumn("text", F.when(F.col("__a").isNull(), F.col("text")).otherwise(F.concat(left, right))).drop("__a", "__b")
        moved = spans.join(ranges, "note_id", "left").where(F.col("__a").isNull() | (F.col("start") < F.col("__a")) | (F.col("start") >= F.col("__b")))
        by = F.when(F.col("start") >= F.col("__b"), F.col("__b") - F.col("__a")).otherwise(0)
        spans = moved.withColumns({"start": (F.col("start") - by).cast("int"), "end": (F.col("end") - by).cast("int")}).drop("__a", "__b")
    return notes, spans


def allowed_sections(annotations: DataFrame, concept_types: DataFrame) -> DataFrame:
    """type, sections: where concepts of a type were seen in training; annotations carry `section`."""
    typed = annotations.where(F.col("section").isNotNull()).join(concept_types, "concept_id")
    return typed.groupBy("type").agg(F.array_sort(F.collect_set("section")).alias("sections"))
