"""Painting spans over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import spans as S
from .spans import longest_wins

# A character takes the class of highest priority.
PRIORITY = {"green": 1, "yellow": 2, "red": 3}


def rank(c: str = "class") -> Column:
    return F.when(F.col(c) == "red", 3).when(F.col(c) == "yellow", 2).otherwise(1)


def paint(spans: DataFrame) -> DataFrame:
    """note_id, start, end, class: runs of characters whose highest class is the same.

    Works on the spans' borders, not on characters: between two borders the class is the highest of the spans that are open,
    which running sums of openings and closings per class tell. Untouched text has no run.
    """
    edges = spans.select("note_id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"), rank().alias("r"))
    sums = edges.groupBy("note_id", F.col("e.pos").alias("pos")).agg(*(F.sum(F.when(F.col("r") == i, F.col("e.d")).otherwise(0)).alias(f"d{i}") for i in (1, 2, 3)))
    w = W.partitionBy("note_id").orderBy("pos")
    open_ = {i: F.sum(f"d{i}").over(w) for i in (1, 2, 3)}
    parts = sums.select("note_id", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.when(open_[3] > 0, "red").when(open_[2] > 0, "yellow").when(open_[1] > 0, "green").alias("class"))
    same = F.lag("class").over(W.partitionBy("note_id").orderBy("start")).eqNullSafe(F.col("class"))
    runs = parts.withColumn("run", F.sum((~same).cast("int")).over(W.partitionBy("note_id").orderBy("start")))
    return runs.where("class is not null").groupBy("note_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("class").alias("class")).drop("run")


def nested_segments(notes: DataFrame, intervals: DataFrame) -> DataFrame:
    """note_id, start, end, stack, shared: the text between two borders of intervals, the intervals that are open there from
    the outermost in, and how many of them, from the outside, are those of the segment before.

    intervals: note_id, start, end, kind (0 locates, 1 colours), name. What begins earlier or ends later is further out, at
    equal borders the lower kind, then the name. Intervals without a character in the text go, those beyond its end are cut.
    """
    size = notes.select("note_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    own = intervals.join(size, "note_id").select("note_id", F.greatest("start", F.lit(0)).cast("int").alias("start"), F.least("end", "size").cast("int").alias("end"), "kind", "name")
    own = own.where(F.col("start") < F.col("end")).distinct()
    borders = own.select("note_id", F.explode(F.array("start", "end")).alias("start"))
    borders = borders.unionByName(size.select("note_id", F.explode(F.array(F.lit(0), F.col("size"))).alias("start"))).distinct()
    w = W.partitionBy("note_id").orderBy("start")
    parts = borders.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("start")))
    pairs = S.overlap_join(parts, own, lambda s1, e1, s2, e2: (s2 <= s1) & (s1 < e2))
    item = F.struct(F.col("r_start").alias("s"), (-F.col("r_end")).alias("e"), F.col("r_kind").alias("kind"), F.col("r_name").alias("name"))
    stacks = pairs.groupBy(F.col("l_note_id").alias("note_id"), F.col("l_start").alias("start")).agg(F.array_sort(F.collect_list(item)).alias("stack"))
    none = F.array().cast("array<struct<s:int,e:int,kind:int,name:string>>")
    whole = parts.join(stacks, ["note_id", "start"], "left").withColumn("stack", F.coalesce("stack", none))
    before = F.coalesce(F.lag("stack").over(w), none)
    same = F.filter(F.sequence(F.lit(0), F.least(F.size("stack"), F.size("before"))), lambda i: F.slice("stack", 1, i) == F.slice("before", 1, i))
    return whole.withColumn("before", before).withColumn("shared", F.size(same) - 1)


def located_html(notes: DataFrame, colours: DataFrame, locates: DataFrame) -> DataFrame:
    """note_id, html: escaped text, with a mark around each coloured span and a span with an id around each located one.

    colours: a span table with class, of which the longest win; locates: note_id, start, end, of which equal ones count once.
    Elements are properly nested whatever overlaps: an interval that another one cuts is closed and opened again, and
    only its first piece has the id (`loc-start-end`); the others name it in data-loc.
    """
    kept = longest_wins(colours).select("note_id", "start", "end", F.lit(1).alias("kind"), F.col("class").alias("name"))
    placed = locates.select("note_id", "start", "end", F.lit(0).alias("kind"), F.concat_ws("-", F.lit("loc"), "start", "end").alias("name"))
    segments = nested_segments(notes, kept.unionByName(placed)).join(notes.select("note_id", "text"), "note_id")
    named = segments.withColumn("piece", F.slice("stack", F.col("shared") + 1, F.size("stack")))
    begin = F.col("start")
    # arrays that a lambda needs pass through the struct of their item, so no lambda looks into another array
    items = F.transform("piece", lambda x: F.when(x["kind"] == 1, F.concat(F.lit('<mark class="'), x["name"], F.lit('">'))).when(x["s"] == begin, F.concat(F.lit('<span id="'), x["name"], F.lit('">'))).otherwise(F.concat(F.lit('<span data-loc="'), x["name"], F.lit('">'))))
    ends = F.transform(F.reverse(F.slice("before", F.col("shared") + 1, F.size("before"))), lambda x: F.when(x["kind"] == 1, "</mark>").otherwise("</span>"))
    text = escape_html(T.slice_text(F.coalesce("text", F.lit("")), F.col("start"), F.col("end")))
    pieces = named.select("note_id", "start", F.concat(F.array_join(ends, ""), F.array_join(items, ""), text).alias("html"))
    joined = pieces.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "html"))).alias("x"))
    return joined.select("note_id", F.array_join(F.transform("x", lambda x: x["html"]), "").alias("html"))


def escape_html(c) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def painted_html(notes: DataFrame, runs: DataFrame) -> DataFrame:
    """note_id, html: escaped text with a mark element around each run of paint()."""
    g = runs.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "class"))).alias("runs"))
    n = notes.select("note_id", F.coalesce("text", F.lit("")).alias("text")).join(g, "note_id", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:int,end:int,class:string>>")))
    piece = lambda r, i: F.concat(escape_html(T.slice_text("text", F.when(i > 0, F.get("runs", i - 1)["end"]).otherwise(0), r["start"])), F.lit('<mark class="'), r["class"], F.lit('">'), escape_html(T.slice_text("text", r["start"], r["end"])), F.lit("</mark>"))
    last = F.when(F.size("runs") > 0, F.element_at("runs", -1)["end"]).otherwise(0)
    return n.select("note_id", F.concat(F.concat_ws("", F.transform("runs", piece)), escape_html(T.slice_text("text", last, F.length("text")))).alias("html"))
