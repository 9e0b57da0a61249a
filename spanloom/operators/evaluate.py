"""Scoring and comparison of span producers: alignment, oracle, regimes, review queue, character IoU, P/R/F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import spans as S
from .shared import cut_lineage, running_sum

# Regimes in their order, and those that go to review.
REGIMES = ("ACCORD", "CONFLIT", "D_SEUL", "S_SEUL", "AUCUN")
QUEUE = REGIMES[1:]


# --- alignment -------------------------------------------------------------------------------------------------------
def best_alignment(gold: DataFrame, pred: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Per gold span (note_id, ord) the prediction with the highest IoU of at least min_iou; the first one (`ord`) at ties.

    note_id, ord, gold_start, gold_end, gold_concept_id, pred_start, pred_end, pred_concept_id, span_iou (0 without one).
    """
    g = S.as_span_table(gold).select("note_id", "ord", "start", "end", "concept_id")
    pairs = S.overlap_join(g, S.as_span_table(pred).select("note_id", "ord", "start", "end", "concept_id"))
    iou = S.span_iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    best = pairs.withColumn("iou", iou).where(F.col("iou") >= min_iou).groupBy(F.col("l_note_id").alias("note_id"), F.col("l_ord").alias("ord")).agg(F.max_by(F.struct("r_start", "r_end", "r_concept_id", "iou"), F.struct("iou", -F.col("r_ord"))).alias("b"))
    return g.join(best, ["note_id", "ord"], "left").select("note_id", "ord", F.col("start").alias("gold_start"), F.col("end").alias("gold_end"), F.col("concept_id").alias("gold_concept_id"), F.col("b.r_start").alias("pred_start"), F.col("b.r_end").alias("pred_end"), F.col("b.r_concept_id").alias("pred_concept_id"), F.coalesce("b.iou", F.lit(0.0)).alias("span_iou"))


def is_hit(pred: str, gold: str = "gold_concept_id") -> Column:
    return F.coalesce(F.col(pred) == F.col(gold), F.lit(False))


def mention_recall(gold: DataFrame, pred: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """One row: n_gold, n_hits, recall (0 without gold)."""
    hit = is_hit("pred_concept_id").cast("int")
    return best_alignment(gold, pred, min_iou).agg(F.count("*").alias("n_gold"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_hits"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("recall"))


def attach_hits(gold: DataFrame, d_pred: DataFrame, s_pred: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Both systems' alignments side by side, joined on the gold key, with d_hit, s_hit, oracle_hit."""

    def side(pred: DataFrame, p: str) -> DataFrame:
        return best_alignment(gold, pred, min_iou).select("note_id", "ord", "gold_start", "gold_end", "gold_concept_id", *(F.col(f"pred_{c}").alias(f"{p}_{c}") for c in ("start", "end", "concept_id")), F.col("span_iou").alias(f"{p}_span_iou"), is_hit("pred_concept_id").alias(f"{p}_hit"))

    return side(d_pred, "d").join(side(s_pred, "s").drop("gold_start", "gold_end", "gold_concept_id"), ["note_id", "ord"]).withColumn("oracle_hit", F.col("d_hit") | F.col("s_hit"))


def oracle_spans(aligned: DataFrame) -> DataFrame:
    """For gold spans that a system hit, the right system's span; the dictionary's if its IoU isn't lower."""
    take = F.col("d_hit") & (~F.col("s_hit") | (F.col("d_span_iou") >= F.col("s_span_iou")))
    pick = lambda c: F.when(take, F.col(f"d_{c}")).otherwise(F.col(f"s_{c}")).alias(c)
    return aligned.where("oracle_hit").select("note_id", "ord", pick("start"), pick("end"), pick("concept_id"), F.when(take, "dict").otherwise("linker").alias("source"))


def oracle_dominates(d: float, s: float, o: float) -> bool:
    """Whether the oracle is as good as both systems, up to rounding; a study must stop where it isn't."""
    return o + 1e-12 >= max(d, s)


def complementarity_delta(d: float, s: float, o: float) -> float:
    return o - max(d, s)


def pair_metrics(gold: DataFrame, d_pred: DataFrame, s_pred: DataFrame, aligned: DataFrame | None = None) -> dict[str, float]:
    """Recall and mean character IoU of both systems and the oracle, and their deltas; raises if the oracle falls behind.
    aligned: attach_hits() of the three, where the caller has it."""
    aligned = attach_hits(gold, d_pred, s_pred) if aligned is None else aligned
    r = aligned.agg(*(F.coalesce(F.avg(F.col(f"{k}_hit").cast("int")), F.lit(0.0)) for k in ("d", "s", "oracle"))).first()
    oracle = oracle_spans(aligned)
    m = [mean_char_iou(gold, p).first()[0] for p in (d_pred, s_pred, oracle)]
    for d, s, o in (r, m):
        if not oracle_dominates(d, s, o):
            raise RuntimeError(f"oracle {o} below {max(d, s)}")
    return {"recall_d": r[0], "recall_s": r[1], "recall_oracle": r[2], "miou_d": m[0], "miou_s": m[1], "miou_oracle": m[2], "delta_recall": complementarity_delta(*r), "delta_miou": complementarity_delta(*m)}


def compare(gold: DataFrame, d_pred: DataFrame, s_pred: DataFrame) -> tuple[dict[str, float], DataFrame, DataFrame]:
    """Metrics of a pair of systems, their alignments with regimes (written once), and the regime table."""
    aligned = cut_lineage(add_regimes(attach_hits(gold, d_pred, s_pred)))
    return pair_metrics(gold, d_pred, s_pred, aligned), aligned, regime_table(aligned)


# --- regimes and review queue ----------------------------------------------------------------------------------------
def add_regimes(aligned: DataFrame) -> DataFrame:
    d, s = F.col("d_concept_id"), F.col("s_concept_id")
    return aligned.withColumn("regime", F.when(d.isNotNull() & s.isNotNull(), F.when(d == s, "ACCORD").otherwise("CONFLIT")).when(d.isNotNull(), "D_SEUL").when(s.isNotNull(), "S_SEUL").otherwise("AUCUN"))


def regime_rank(c: str = "regime") -> Column:
    return F.array_position(F.array(*map(F.lit, REGIMES)), F.col(c))


def regime_table(aligned: DataFrame) -> DataFrame:
    """regime, n, pct, p_error, d_only_correct, s_only_correct, both_correct; regimes without rows are absent."""
    d, s = F.col("d_hit"), F.col("s_hit")
    g = aligned.groupBy("regime").agg(F.count("*").alias("n"), (1 - F.avg(F.col("oracle_hit").cast("int"))).alias("p_error"), F.count_if(d & ~s).alias("d_only_correct"), F.count_if(s & ~d).alias("s_only_correct"), F.count_if(d & s).alias("both_correct"))
    return g.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).orderBy(regime_rank())


def add_queue_flag(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("in_queue", F.col("regime").isin(*QUEUE)).withColumn("is_error", ~F.col("oracle_hit"))


def queue_metrics(aligned: DataFrame) -> DataFrame:
    """One row of nine numbers; an empty queue has precision 0, no error means recall 1."""
    q, e = F.col("in_queue"), F.col("is_error")
    c = add_queue_flag(aligned).agg(F.count("*").alias("n"), F.count_if(e).alias("err"), F.count_if(q).alias("que"), F.count_if(q & e).alias("eq"), F.count_if(~q & e).alias("ea"))
    n = F.greatest(F.col("n"), F.lit(1))
    part = lambda a, b, default: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(float(default)))
    return c.select(n.cast("double").alias("n_mentions"), F.col("err").cast("double").alias("n_errors"), F.col("que").cast("double").alias("n_queue"), (F.col("que") / n).alias("queue_coverage"), (F.col("err") / n).alias("error_rate_all"), part("eq", "err", 1).alias("error_recall"), part("eq", "que", 0).alias("error_precision"), F.col("ea").cast("double").alias("n_errors_in_accord"), part("ea", "err", 0).alias("accord_error_share"))


def queue_by_regime(aligned: DataFrame) -> DataFrame:
    g = add_queue_flag(aligned).groupBy("regime").agg(F.first("in_queue").alias("in_queue"), F.count("*").alias("n"), F.count_if("is_error").alias("n_errors"))
    total = F.greatest(F.sum("n_errors").over(W.partitionBy(F.lit(1))), F.lit(1))
    return g.withColumn("p_error", F.col("n_errors") / F.col("n")).withColumn("share_of_all_errors", F.col("n_errors") / total).orderBy(regime_rank())


def queue_report(metrics: DataFrame, by_regime: DataFrame) -> str:
    """A Markdown section of the one row of queue_metrics() and the rows, a regime each, of queue_by_regime()."""
    m = metrics.first()
    lines = ["## Review queue", "", "| metric | value |", "|---|---:|", *(f"| {k} | {v:.4f} |" for k, v in m.asDict().items()), ""]
    lines += ["| regime | in queue | n | errors | P(error) | share of errors |", "|---|---|---:|---:|---:|---:|"]
    rows = by_regime.limit(len(REGIMES)).collect()
    return "\n".join([*lines, *(f"| {r.regime} | {'yes' if r.in_queue else 'no'} | {r.n} | {r.n_errors} | {r.p_error:.3f} | {100 * r.share_of_all_errors:.1f} |" for r in rows)]) + "\n"


def sample_examples(aligned: DataFrame, per_regime: int = 2, seed: int = 0) -> DataFrame:
    """A few rows of each regime, the first by md5("note_id|ord|seed"); reproducible, without replacement. Rows are ranked with
    a limit, so each task sends on no more than that of a regime."""
    by = F.md5(F.concat_ws("|", "note_id", F.col("ord").cast("string"), F.lit(str(seed))).cast("binary"))
    return aligned.withColumn("__r", F.row_number().over(W.partitionBy("regime").orderBy(by, "note_id", "ord"))).where(F.col("__r") <= per_regime).drop("__r")


# --- character and note scores ---------------------------------------------------------------------------------------
def char_table(spans: DataFrame) -> DataFrame:
    """note_id, pos, concept_id; at a character the span with the highest `ord` counts. Only characters of spans exist."""
    chars = spans.select("note_id", "ord", "concept_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    return chars.groupBy("note_id", "pos").agg(F.max_by("concept_id", "ord").alias("concept_id"))


def _char_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """concept_id, n_both, n_either of some notes each. Both sides' spans meet by note and are painted, in the order of `ord`, on the
    pieces that their ends cut the text into: no character is a row. A task holds the spans of some notes."""
    side = lambda df, g: df.where("start < end and note_id is not null").select("note_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("concept_id").cast("long").alias("c"), F.col("ord").cast("long").alias("o"), F.lit(g).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.whole_notes(batches):
            note = batch.column(0).dictionary_encode().indices.to_numpy().astype(np.int64) << 33
            begin, end = (batch.column(i).to_numpy() + note for i in (1, 2))
            known = batch.column(3).drop_null().unique().sort()
            code = pc.fill_null(pc.index_in(batch.column(3), known), -1).to_numpy()
            order, gold_ = pc.fill_null(batch.column(4), -1).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate([begin, end]))
            size, first, last = np.diff(cuts), np.searchsorted(cuts, begin), np.searchsorted(cuts, end)
            painted = []
            for own in (gold_, ~gold_):
                at = np.flatnonzero(own)
                at = at[np.argsort(order[at], kind="stable")]
                many = last[at] - first[at]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                top = np.full(len(size), -1)
                top[np.repeat(first[at], many) + inside] = np.repeat(code[at], many)  # the last one of a piece stays
                painted.append(top)
            g, p = painted
            count = lambda codes, where: np.bincount(codes[where], size[where], len(known)).astype(np.int64)  # noqa: B023, E731
            both = count(g, (g >= 0) & (g == p))
            yield pa.RecordBatch.from_arrays([known, pa.array(both), pa.array(count(g, g >= 0) + count(p, p >= 0) - both)], names=["concept_id", "n_both", "n_either"])

    dealt = side(gold, True).unionByName(side(pred, False)).repartition("note_id").sortWithinPartitions("note_id")
    return dealt.mapInArrow(run, "concept_id long, n_both long, n_either long")


def char_iou(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """concept_id, n_both, n_either, iou for each concept of either side; 0 for one that is overwritten everywhere."""
    counts = _char_counts(gold, pred).groupBy("concept_id").agg(F.sum("n_both").alias("n_both"), F.sum("n_either").alias("n_either"))
    domain = gold.select("concept_id").unionByName(pred.select("concept_id")).distinct()
    return domain.join(counts, "concept_id", "left").select("concept_id", F.coalesce("n_both", F.lit(0)).alias("n_both"), F.coalesce("n_either", F.lit(0)).alias("n_either"), F.coalesce(F.try_divide("n_both", "n_either"), F.lit(0.0)).alias("iou"))


def mean_char_iou(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: the macro mean over concepts; 0 without predictions."""
    found = char_iou(gold, pred).agg(F.avg("iou").alias("iou"))
    return found.crossJoin(pred.limit(1).agg(F.count("*").alias("n"))).select(F.when(F.col("n") > 0, F.coalesce("iou", F.lit(0.0))).otherwise(0.0).alias("mean_iou"))


def note_jaccard(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """note_id, jaccard of the concept sets, for notes that both have."""
    g, p = (d.groupBy("note_id").agg(F.collect_set("concept_id").alias(n)) for d, n in ((gold, "g"), (pred, "p")))
    return g.join(p, "note_id").select("note_id", (F.size(F.array_intersect("g", "p")) / F.size(F.array_union("g", "p"))).alias("jaccard"))


def scores_where_predicted(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """mean_iou and mean_jaccard with gold restricted to notes that have predictions; other notes aren't penalised."""
    kept = gold.join(pred.select("note_id").distinct(), "note_id", "left_semi")
    return mean_char_iou(kept, pred).crossJoin(note_jaccard(kept, pred).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("mean_jaccard")))


# --- precision, recall, F1 -------------------------------------------------------------------------------------------
def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def prf_exact(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("note_id", "start", "end")) -> DataFrame:
    """One row; distinct spans of notes that have gold. keys must hold note_id: both sides are dealt by it once, and counted there.
    Spans with a null among their keys equal none."""
    side = lambda df, g: df.select(*keys, F.lit(g).alias("g"), F.lit(not g).alias("p"))
    known = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0
    spans = side(gold, True).unionByName(side(pred, False)).repartition("note_id").groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    hit = F.col("g") & F.col("p") & known
    notes = spans.groupBy("note_id").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("p") & ~hit).alias("fp"), F.count_if(F.col("g") & ~hit).alias("fn"), F.max("g").alias("g"))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    c = notes.where("g").agg(total("tp").alias("tp"), total(F.when(F.col("note_id").isNotNull(), F.col("fp")).otherwise(0)).alias("fp"), total("fn").alias("fn"))
    return c.select(*_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def span_classes(gold: DataFrame, pred: DataFrame, same_label: bool = False) -> DataFrame:
    """note_id, ord, start, end, class: predictions green (overlap gold) or yellow (none), gold red where nothing overlaps."""
    same = (F.col("l_concept_id") == F.col("r_concept_id")) if same_label else F.lit(True)

    def hit(a: DataFrame, b: DataFrame) -> DataFrame:
        found = S.overlap_join(a.select("note_id", "ord", "start", "end", "concept_id"), b.select("note_id", "ord", "start", "end", "concept_id")).where(same)
        return found.select(F.col("l_note_id").alias("note_id"), F.col("l_ord").alias("ord")).distinct().withColumn("hit", F.lit(True))

    p = pred.join(hit(pred, gold), ["note_id", "ord"], "left").select("note_id", "ord", "start", "end", F.when(F.col("hit"), "green").otherwise("yellow").alias("class"))
    g = gold.join(hit(gold, pred), ["note_id", "ord"], "left_anti").select("note_id", "ord", "start", "end", F.lit("red").alias("class"))
    return p.unionByName(g)


def prf_overlap(gold: DataFrame, pred: DataFrame, same_label: bool = False) -> DataFrame:
    """One row; true positives per prediction, false negatives per distinct gold span."""
    classes = span_classes(gold, pred, same_label)
    red = F.count_distinct(F.when(F.col("class") == "red", F.struct("note_id", "start", "end")))
    c = classes.agg(F.count_if(F.col("class") == "green").alias("tp"), F.count_if(F.col("class") == "yellow").alias("fp"), red.alias("fn"))
    return c.select(*_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def missed_gold(gold: DataFrame, pred: DataFrame, dictionary: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """Gold spans (named: with `term`) that no prediction above the threshold overlaps, and why: filtered, where a weaker one
    does; in_dictionary, where the term is known; absent."""
    strong = pred.where(F.col("score") >= threshold)
    missed = S.overlapping(named, strong, keep=False)
    weak = S.overlapping(missed, pred.where(F.col("score") < threshold)).select("note_id", "ord").withColumn("weak", F.lit(True))
    known = dictionary.select("term").distinct().withColumn("known", F.lit(True))
    why = F.when(F.col("weak"), "filtered").when(F.col("known"), "in_dictionary").otherwise("absent")
    return missed.join(weak, ["note_id", "ord"], "left").join(known, "term", "left").select("note_id", "ord", "start", "end", "concept_id", why.alias("reason"))


# --- classification --------------------------------------------------------------------------------------------------
def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """gold, pred, n, share of the gold class."""
    c = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("gold")))


def class_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """class, tp, fp, fn, f1, iou of each class of either side."""
    c = confusion(df, gold, pred)
    pairs = c.select(F.explode(F.array_distinct(F.array("gold", "pred"))).alias("class"), "gold", "pred", "n")
    mine = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g, p, k = F.col("gold"), F.col("pred"), F.col("class")
    s = pairs.groupBy("class").agg(mine((g == k) & (p == k)).alias("tp"), mine((g != k) & (p == k)).alias("fp"), mine((g == k) & (p != k)).alias("fn"))
    return s.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("iou", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")))


def f1_summary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: micro_f1, macro_f1, mean_iou."""
    s = class_scores(df, gold, pred)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return s.agg((2 * tp / (2 * tp + fp + fn)).alias("micro_f1"), F.avg("f1").alias("macro_f1"), F.avg("iou").alias("mean_iou"))


def pair_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc of a score for a 0/1 label; null without both labels. Scores are counted first, then summed up in order."""
    by = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    u = running_sum(by, ["s"], F.col("neg"), "upto").withColumn("u", F.col("pos") * (F.col("upto") - F.col("neg") / 2)).agg(F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return u.select(F.when(F.col("p") * F.col("n") > 0, F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def one_vs_one_auc(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """auc: the mean over ordered pairs (a, b) of classes of the AUC of a's score among rows of a and b. label: 0 to classes - 1;
    scores: an array with one number a class. Null where a pair has no rows of either class.

    A row counts in 2 (classes - 1) pairs; equal scores are counted first, and sums run over all pairs in one order, so that
    no pair is a task of its own.
    """
    k = F.col(label)
    other = F.filter(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: c != k)
    own = F.transform(other, lambda c: F.struct(k.cast("int").alias("a"), c.alias("b"), F.get(scores, k.cast("int")).alias("s"), F.lit(1).alias("y")))
    far = F.transform(other, lambda c: F.struct(c.alias("a"), k.cast("int").alias("b"), F.get(scores, c).alias("s"), F.lit(0).alias("y")))
    rows = df.where(k.isNotNull() & F.col(scores).isNotNull()).select(F.explode(F.concat(own, far)).alias("x")).select("x.*")
    by = rows.groupBy("a", "b", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    summed = running_sum(by, ["a", "b", "s"], F.col("neg"), "upto")
    first = summed.groupBy("a", "b").agg(F.min(F.col("upto") - F.col("neg")).alias("before"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"))
    pairs = classes * (classes - 1)
    each = first.select(F.try_divide(F.col("u") - F.col("p") * F.col("before"), F.col("p") * F.col("n")).alias("auc")).where(F.col("auc").isNotNull())
    return each.agg(F.when(F.count("*") == pairs, F.avg("auc")).alias("auc"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def study_report(title: str, metrics: dict[str, float], table: DataFrame) -> str:
    """A Markdown section: the metrics and the regime table (at most five rows reach the driver)."""
    rows = table.limit(len(REGIMES)).collect()
    lines = [f"## {title}", "", "| metric | value |", "|---|---:|", *(f"| {k} | {v:.4f} |" for k, v in metrics.items()), "", "| regime | n | % | P(error) |", "|---|---:|---:|---:|"]
    return "\n".join([*lines, *(f"| {r.regime} | {r.n} | {100 * r.pct:.1f} | {r.p_error:.3f} |" for r in rows)]) + "\n"
