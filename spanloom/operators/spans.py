"""The span table and its algebra: contract, slices, overlap joins, overlap resolution."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as spark_types

from ..functions import text as T

REQUIRED = ("note_id", "start", "end", "concept_id")
#: Spans that a kernel holds as Python objects at once.
RUN_SPANS = 1 << 16


def as_span_table(df: DataFrame) -> DataFrame:
    """Cast the four columns of a span table, drop spans with start >= end, keep other columns. Missing ones raise."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    kinds = {"note_id": "string", "start": "int", "end": "int", "concept_id": "bigint"}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).where(F.col("start") < F.col("end"))


def submission_view(df: DataFrame) -> DataFrame:
    return as_span_table(df).select(*REQUIRED)


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """Number the rows of each note from 0 in the order of `by`, as `ord`."""
    return df.withColumn("ord", F.row_number().over(W.partitionBy("note_id").orderBy(*by)) - 1)


# Overlap predicates on (start, end, start, end). They differ at touching ends on purpose.
def strict_overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(s1, s2) < F.least(e1, e2)


def inclusive_overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(s1, s2) <= F.least(e1, e2)


def left_anchored_overlap(s1, e1, s2, e2) -> Column:
    return (s1 <= s2) & (s2 < e1)


def span_iou(s1, e1, s2, e2) -> Column:
    """Overlap over union of two intervals; 0 for an empty union."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, predicate=strict_overlap, how: str = "inner", bucket: int = 256) -> DataFrame:
    """Pairs of spans of the same note that overlap; columns of left as l_*, of right as r_*.

    Both sides are dealt to the buckets of positions they touch and joined on (note, bucket), so that a note with very many
    spans is spread; a pair counts only in the later one of its first buckets, so none is doubled. how: inner, left (left
    rows without a partner stay), left_semi or left_anti.
    """
    key = "__key" if how != "inner" else None
    if key:
        left = left.withColumn(key, F.struct(*left.columns))
    touched = lambda s, e: F.sequence(F.floor(s / bucket), F.floor(e / bucket))  # noqa: E731  # an end that touches counts
    l = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.explode(touched(F.col("start"), F.col("end"))).alias("l_bucket"))
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.explode(touched(F.col("start"), F.col("end"))).alias("r_bucket"))
    first = F.greatest(F.floor(F.col("l_start") / bucket), F.floor(F.col("r_start") / bucket))
    on = (F.col("l_note_id") == F.col("r_note_id")) & (F.col("l_bucket") == F.col("r_bucket")) & predicate(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    if how == "inner":
        return l.join(r, on & (F.col("l_bucket") == first)).drop("l_bucket", "r_bucket")
    raise ValueError("use overlapping() or with_partners() for other joins")


def overlapping(left: DataFrame, right: DataFrame, predicate=strict_overlap, keep: bool = True, bucket: int = 256) -> DataFrame:
    """Rows of left that overlap some row of right (keep) or none (not keep). `ord` must number the rows of a note."""
    hit = overlap_join(left.select("note_id", "ord", "start", "end"), right.select("note_id", "start", "end"), predicate, bucket=bucket)
    hit = hit.select(F.col("l_note_id").alias("note_id"), F.col("l_ord").alias("ord")).distinct()
    return left.join(hit, ["note_id", "ord"], "left_semi" if keep else "left_anti")


def _along(df: DataFrame, touching: bool, choose) -> DataFrame:
    """Rows of df that choose(starts, ends, batch) names by their places, chain by chain of overlapping (or touching) spans.

    Notes are clustered and their spans sorted by (start, end, ord), or numbered in the order of (start, end) where df has no `ord`;
    a narrow pass reads this stream, finds the chains by the highest end so far, and gives many whole ones to choose() at once.
    bound: where each of them begins, and the end of the last. No window function: all is done in the pass.
    """
    numbered = "ord" not in df.columns
    out = spark_types.StructType([*df.schema.fields, spark_types.StructField("ord", spark_types.IntegerType())]) if numbered else df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        note, high, count = None, 0, 0  # of the row before: its note, the highest end and the number of rows of that note so far
        for batch in batches:
            if not len(batch):
                continue
            code = pc.fill_null(batch.column("note_id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            start, end = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            goes_on = note is not None and batch.column("note_id")[0] == note
            other = np.append(not goes_on, code[1:] != code[:-1])
            segment = np.cumsum(other)
            reach = np.maximum.accumulate(np.append(high if goes_on else -1, end) + (np.append(segment[0], segment) << 33))
            before = reach[:-1] - (segment << 33)  # of another note: below zero
            fresh = other | ((start > before) if touching else (start >= before))
            if numbered:
                first = np.flatnonzero(np.append(True, other[1:]))
                order = np.arange(len(batch)) - np.repeat(first, np.diff(np.append(first, len(batch))))
                order[segment == segment[0]] += count if goes_on else 0
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32))], names=out.names)
                count = int(order[-1]) + 1
            note, high = batch.column("note_id")[len(batch) - 1], int(reach[-1] - (segment[-1] << 33))
            last = np.flatnonzero(fresh)
            if not len(last):
                held.append((batch, fresh))
                continue
            yield from done([*held, (batch.slice(0, last[-1]), fresh[: last[-1]])])
            held = [(batch.slice(last[-1]), fresh[last[-1] :])]
        yield from done(held)

    def done(parts: list[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([p for p, _ in parts if len(p)], parts[0][0].schema).combine_chunks() if parts else None
        at, fresh = 0, np.concatenate([f for _, f in parts]) if parts else None
        for batch in table.to_batches() if table is not None and len(table) else ():
            bound = np.concatenate([[0], np.flatnonzero(fresh[at : at + len(batch)]), [len(batch)]])
            at += len(batch)
            start, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            yield batch.take(pa.array(choose(start, end, np.unique(bound), batch), pa.int64()))

    order = ["note_id", "start", "end"] + ["ord"] * (not numbered)
    return df.repartition("note_id").sortWithinPartitions(*order).mapInArrow(run, out)


def whole_notes(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` (RUN_SPANS) rows that end where a note ends; notes lie together in the stream, and note_id comes first."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= (rows or RUN_SPANS):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = pc.index(whole.column(0), whole.column(0)[len(whole) - 1]).as_py()  # where the last note, which may go on, begins
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(max(cut, 0))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chain_bounds(note: np.ndarray, start: np.ndarray, end: np.ndarray, touching: bool = False) -> np.ndarray:
    """Where each chain of overlapping (or touching) spans begins, and the end of the last; rows are sorted by (note, start, end),
    notes numbered."""
    reach = np.maximum.accumulate(end.astype(np.int64) + (note << 33))
    fresh = start[1:] - touching >= reach[:-1] - (note[1:] << 33)
    return np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(start)]]) if len(start) else np.zeros(1, np.int64)


#: Rounds in which the longest of each chain is taken for all chains at once; what is left then goes one by one.
ROUNDS = 32


def longest_of(start: np.ndarray, end: np.ndarray, order: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Places of the spans that longest_wins() takes, of chains that begin at `bound`; order: their `ord`.

    The best span of each chain is taken and those that overlap it go, which parts the chain; so all chains are done together.
    """
    start, end, size = start.astype(np.int64), end.astype(np.int64), np.diff(bound)
    chain = np.repeat(np.arange(len(size)), size)
    left = np.flatnonzero(size[chain] > 1)
    empty = start[left] >= end[left]  # neither taken from nor held against others
    taken = [bound[:-1][size == 1], left[empty]]
    left = left[~empty]
    best_first = left[np.lexsort((order[left], -end[left], start[left] - end[left]))]
    rank = np.zeros(len(start), np.int64)
    rank[best_first] = np.arange(len(best_first))
    for _ in range(ROUNDS):
        if not len(left):
            break
        first = chain_bounds(chain[left], start[left], end[left])
        best = best_first[np.minimum.reduceat(rank[left], first[:-1])]
        taken.append(best)
        s, e = (np.repeat(x[best], np.diff(first)) for x in (start, end))
        left = left[(start[left] >= e) | (end[left] <= s)]
    left = left[np.lexsort((rank[left], chain[left]))]
    current, begins, ends = -1, [], []
    for i, c, s, e in zip(left.tolist(), chain[left].tolist(), start[left].tolist(), end[left].tolist(), strict=True):
        if c != current:
            current, begins, ends = c, [], []
        k = bisect.bisect_right(begins, s)
        if k and ends[k - 1] > s or k < len(begins) and begins[k] < e:
            continue
        begins.insert(k, s)
        ends.insert(k, e)
        taken.append(np.array([i]))
    return np.sort(np.concatenate(taken))


def longest_wins(df: DataFrame) -> DataFrame:
    """Greedy choice of spans that don't overlap: longest first, then the later end, then the lower `ord`.

    Where there is no `ord`, spans are numbered from 0 in the order of (start, end). Done within chains of overlapping spans, which
    are short however many spans a note has, a batch of chains at a time.
    """
    return _along(df, False, lambda start, end, bound, batch: longest_of(start, end, batch.column("ord").to_numpy(zero_copy_only=False), bound))


def alternation_scan(hits: DataFrame) -> DataFrame:
    """Leftmost matches that don't overlap; at equal starts the entry with the lower `dict_ord` wins, not the longer one."""
    names = ["note_id", "start", *(c for c in hits.columns if c not in ("note_id", "start", "ord"))]
    numbered = hits.withColumn("__first", F.row_number().over(W.partitionBy("note_id").orderBy("start", "dict_ord", "end")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reach = None, 0  # the start looked at last, and the end of the last match taken
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("__first", "start", "end"))
            for i, (n, start, end) in enumerate(zip(*columns, strict=True)):
                if n == 1:
                    at, reach = None, start
                if start != at and start >= reach:
                    kept.append(i)
                    reach = end
                at = start
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    schema = spark_types.StructType([hits.schema[c] for c in names])
    return numbered.select(*names, "__first").mapInArrow(run, schema)


def sweep(rows: list[tuple[int, int, float]]) -> list[int]:
    """Which of (start, end, weight), in this order, survive: a fold over the arriving spans, then one over those that fell.

    The state holds the open spans: those that stand, reach beyond the arriving one and have not met a heavier one yet. An open
    span that is lighter than the arriving one falls and is closed; if any is not, the arriving one falls, else it becomes
    open. Every span meets the arriving one, whether that falls or not. Of the fallen, in order, those come back whose start and end
    lie within none that stands by then; an end counts as outside.
    """
    fallen: list[int] = []
    opened: list[int] = []
    for i, (start, _, weight) in enumerate(rows):
        reaching = [o for o in opened if rows[o][1] > start]
        heavier = [o for o in reaching if rows[o][2] >= weight]
        fallen += [o for o in reaching if rows[o][2] < weight]
        if heavier:
            fallen.append(i)
        opened = heavier + [i] * (not heavier)
    standing = sorted(set(range(len(rows))) - set(fallen))
    widest = max((e - s for s, e, _ in rows), default=0)
    spans = [rows[i][:2] for i in standing]

    def covered(at: int) -> bool:
        near = range(bisect.bisect_left(spans, (at - widest + 1,)), bisect.bisect_right(spans, (at, math.inf)))
        return any(spans[k][1] > at for k in near)

    for i in sorted(fallen):
        if not covered(rows[i][0]) and not covered(rows[i][1]):
            bisect.insort(spans, rows[i][:2])
            standing.append(i)
    return sorted(standing)


def remove_overlaps(df: DataFrame) -> DataFrame:
    """Resolve overlaps by weight: length, less 0.1 where the entry holds for any section (`any_section`).

    The sweep depends on order within chains of spans that overlap or touch; chains don't affect each other, so a batch of them
    is swept at a time. Ties are by (start, end, ord). A dropped span may come back, so overlaps can remain by design.
    """

    return _along(df, True, lambda start, end, bound, batch: swept(start, end, bound, batch.column("any_section")))


def swept(start: np.ndarray, end: np.ndarray, bound: np.ndarray, any_section: pa.Array) -> list[int]:
    """Places of the spans that remove_overlaps() keeps, of chains that begin at `bound`."""
    weight = (end - start) - 0.1 * any_section.to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(bound)
    out = bound[:-1][size == 1].tolist()
    for a, b in zip(bound[:-1][size > 1].tolist(), bound[1:][size > 1].tolist(), strict=True):
        out += [a + i for i in sweep(list(zip(start[a:b].tolist(), end[a:b].tolist(), weight[a:b].tolist(), strict=True)))]
    return sorted(out)


def leftmost_of(note: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the spans that alternation_scan() takes; sorted by (note, start, end), rank: the order of their `dict_ord`."""
    by = np.lexsort((rank, start, note))
    at = start.astype(np.int64) + (note << 33)
    by = by[np.append(True, at[by][1:] != at[by][:-1])[: len(by)]]  # the first of each start
    following = np.searchsorted(at[by], end[by].astype(np.int64) + (note[by] << 33))
    bound = chain_bounds(note[by], start[by], end[by])
    limit = np.repeat(bound[1:], np.diff(bound))
    now, taken = bound[:-1], [np.zeros(0, np.int64)]
    while len(now):  # one of each chain that goes on, for all chains together
        taken.append(now)
        now = following[now][following[now] < limit[now]]
    return np.sort(by[np.concatenate(taken)])


def first_pairs(note: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of first_overlaps(): of each note's first pair, both members; sorted by (note, start, end), which is their `ord`."""
    n, at = len(start), start.astype(np.int64) + (note << 33)
    first = np.append(True, at[1:] != at[:-1])[:n]
    partner = np.where(first, np.arange(n) + 1, np.flatnonzero(first)[np.cumsum(first) - 1] if n else 0)
    inside = np.flatnonzero(partner < n)
    other = partner[inside]
    found = inside[(note[other] == note[inside]) & (start[inside] < end[inside]) & (start[other] < end[inside])]
    found = found[np.append(True, note[found][1:] != note[found][:-1])[: len(found)]]
    return found, partner[found]


def first_overlaps(df: DataFrame) -> DataFrame:
    """The first left-anchored overlapping pair of each note (by starts and ords). `ord` numbers the rows of a note.

    No pair but the first is made: in order, the first partner of a span is the first other one that begins where it does,
    else the one behind it.
    """
    in_note = W.partitionBy("note_id").orderBy("start", "ord", "end")
    at_start = W.partitionBy("note_id", "start").orderBy("ord", "end")
    span = F.struct("start", "ord", "end")
    ahead = df.select("note_id", "start", "end", "ord", F.row_number().over(at_start).alias("__n"), F.first(span).over(at_start).alias("__same"), F.lead(span).over(in_note).alias("__next"))
    partner = F.when(F.col("__n") > 1, F.col("__same")).otherwise(F.col("__next"))
    pairs = ahead.where(F.col("start") < F.col("end")).withColumn("r", partner).where(F.col("r.start") < F.col("end"))
    first = pairs.groupBy("note_id").agg(F.min(F.struct("start", "ord", "end", "r")).alias("p"))
    return first.select("note_id", F.col("p.start").alias("start1"), F.col("p.end").alias("end1"), F.col("p.r.start").alias("start2"), F.col("p.r.end").alias("end2"))


def with_surface(spans: DataFrame, notes: DataFrame, name: str = "surface") -> DataFrame:
    """Add text[start:end] of each span; null for a null text. Spans that carry the column already keep it.

    A note's text meets all its spans at once, in an Arrow kernel, so it isn't searched from its start for each of them. The
    join by note shuffles the texts unless the planner broadcasts the spans or the notes are bucketed by note_id; spans
    that are made of tokens should carry their surface instead (tokens.token_table(pairs=True))."""
    if name in spans.columns:
        return spans
    rest = [c for c in spans.columns if c != "note_id"]
    grouped = spans.groupBy("note_id").agg(F.collect_list(F.struct(*rest)).alias("__spans"))
    joined = grouped.join(notes.select("note_id", F.col("text").alias("__text")), "note_id").select("note_id", "__text", "__spans")
    return noted_surfaces(joined, "__text", "__spans", name).select(*spans.columns, name)


def noted_surfaces(noted: DataFrame, text: str = "text", spans: str = "spans", name: str = "surface") -> DataFrame:
    """note_id, the fields of `spans` and the text of each: of notes that carry an array of their spans (structs with start and end), which
    needs no shuffle. Null and empty arrays have no rows; a null text gives nulls."""
    joined = noted.select("note_id", text, F.coalesce(spans, F.array().cast(noted.schema[spans].dataType)).alias(spans))
    fields = noted.schema[spans].dataType.elementType.fields
    rest = [f.name for f in fields]
    out = spark_types.StructType([noted.schema["note_id"], *fields, spark_types.StructField(name, spark_types.StringType())])
    start, end = rest.index("start"), rest.index("end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(items).to_numpy())
            fields = items.flatten().flatten()
            current, text = -1, None
            for at in range(0, len(owner), RUN_SPANS):  # what is held as Python objects: a run of spans and one text
                part = [f.slice(at, RUN_SPANS) for f in fields]
                of, surfaces = owner[at : at + RUN_SPANS], []
                for row, i, j in zip(of.tolist(), part[start].to_pylist(), part[end].to_pylist(), strict=True):
                    if row != current:
                        current, text = row, batch.column(1)[row].as_py()
                    surfaces.append(None if text is None else text[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *part, pa.array(surfaces, pa.string())], names=out.names)

    return joined.mapInArrow(run, out)


def wrong_offsets(spans: DataFrame, notes: DataFrame, surface: str = "span") -> DataFrame:
    """The spans whose stored surface differs from the text at their offsets."""
    return with_surface(spans, notes, "__found").where(~F.col("__found").eqNullSafe(F.col(surface))).drop("__found")


def offset_mismatches(spans: DataFrame, notes: DataFrame, surface: str = "span") -> int:
    """How many spans' stored surface differs from the text at their offsets."""
    return wrong_offsets(spans, notes, surface).count()


def check_offsets(spans: DataFrame, notes: DataFrame, surface: str = "span") -> DataFrame:
    n = offset_mismatches(spans, notes, surface)
    if n:
        raise ValueError(f"{n} spans don't match their text")
    return spans


def merge_submissions(neural: DataFrame, static: DataFrame, require_neural: bool = True) -> DataFrame:
    """Neural spans, and static ones that touch none of their note; only notes with a neural span get static ones."""
    free = overlapping(static, neural, inclusive_overlap, keep=False)
    if require_neural:
        free = free.join(neural.select("note_id").distinct(), "note_id", "left_semi")
    return submission_view(neural).unionByName(submission_view(free))


def neural_residual(spans: DataFrame, notes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spans whose normalised surface is no term of the dictionary, or has another concept there."""
    named = with_surface(spans, notes).withColumn("term", T.normalize_term("surface"))
    joined = named.join(dictionary.select("term", F.col("concept_id").alias("dict_concept")), "term", "left")
    return submission_view(joined.where(F.col("dict_concept").isNull() | (F.col("dict_concept") != F.col("concept_id"))))
