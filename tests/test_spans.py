import random

from pyspark.sql import functions as F

import pytest
from spanloom.operators import dictionary as D
from spanloom.operators import evaluate as E
from spanloom.operators import present as P
from spanloom.operators import sections as H
from spanloom.operators import spans as S

SPAN = "note_id string, start int, end int, concept_id long, ord int"


def spans(spark, rows):
    return spark.createDataFrame([(n, s, e, c, i) for i, (n, s, e, c) in enumerate(rows)], SPAN)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_span_table_contract(spark):
    df = spark.createDataFrame([("a", 3, 3, 1, "x"), ("a", 1, 4, 2, "y")], "note_id string, start int, end int, concept_id int, more string")
    assert rows(S.as_span_table(df), "start", "end", "concept_id", "more") == [(1, 4, 2, "y")]
    assert S.submission_view(df).columns == list(S.REQUIRED)
    with pytest.raises(ValueError, match="missing"):
        S.as_span_table(df.drop("end"))


def test_alignment_prefers_iou_and_misses_below_threshold(spark):
    gold = spans(spark, [("n1", 0, 10, 1)])
    best = E.best_alignment(gold, spans(spark, [("n1", 0, 4, 9), ("n1", 0, 10, 1)])).first()
    assert (best.pred_concept_id, best.span_iou) == (1, 1.0)
    none = E.best_alignment(gold, spans(spark, [("n1", 0, 3, 1)])).first()
    assert none.pred_concept_id is None and none.span_iou == 0.0
    assert E.mention_recall(gold, spans(spark, [("n1", 0, 3, 1)])).first().recall == 0.0
    tie = E.best_alignment(gold, spans(spark, [("n1", 0, 10, 5), ("n1", 0, 10, 6)])).first()
    assert tie.pred_concept_id == 5


def test_regimes_oracle_and_queue(spark):
    gold = spans(spark, [("n", 0, 4, 1), ("n", 10, 14, 2), ("n", 20, 24, 3), ("n", 30, 34, 4)])
    d = spans(spark, [("n", 0, 4, 1), ("n", 10, 14, 99), ("n", 20, 24, 3)])
    s = spans(spark, [("n", 0, 4, 1), ("n", 10, 14, 2), ("n", 30, 34, 4)])
    aligned = E.add_regimes(E.attach_hits(gold, d, s))
    assert [r.regime for r in aligned.orderBy("ord").collect()] == ["ACCORD", "CONFLIT", "D_SEUL", "S_SEUL"]
    m = E.pair_metrics(gold, d, s)
    assert m["recall_oracle"] == 1.0 and m["delta_recall"] > 0
    assert rows(E.oracle_spans(aligned), "concept_id", "source")[0] == (1, "dict")
    assert "ACCORD" in E.study_report("A", m, E.regime_table(aligned))


def test_queue_metrics(spark):
    a = spark.createDataFrame([("ACCORD", True), ("ACCORD", False), ("CONFLIT", False), ("S_SEUL", True), ("AUCUN", False)], "regime string, oracle_hit boolean")
    q = E.queue_metrics(a).first()
    assert (q.n_queue, round(q.error_recall, 6), q.n_errors_in_accord) == (3, round(2 / 3, 6), 1)
    empty = E.queue_metrics(a.where("false")).first()
    assert (empty.error_recall, empty.error_precision) == (1.0, 0.0)


def test_dictionary_finds_long_terms_once(spark):
    notes = spark.createDataFrame([("n1", "Patient with chest pain yesterday.")], "note_id string, text string")
    lexicon = spark.createDataFrame([("chest pain", 279084009), ("pain", 22253000)], "term string, concept_id long")
    found = rows(D.predict_with_dictionary(notes, lexicon, 2), "start", "end", "concept_id")
    assert found == [(13, 23, 279084009)]


def test_tokens_count_code_points(spark):
    notes = spark.createDataFrame([("a", "é 😀ab c9-Z"), ("b", ""), ("c", None), ("d", "x")], "note_id string, text string")
    assert rows(D.token_table(notes), "note_id", "ord", "tok", "start", "end") == [("a", 0, "ab", 3, 5), ("a", 1, "c9", 6, 8), ("a", 2, "z", 9, 10), ("d", 0, "x", 0, 1)]


def test_section_dictionary_learns_and_predicts(spark):
    text = "x" * 100 + "Past Medical History:\n\nhypotension was recorded.\n"
    notes = spark.createDataFrame([("n", text.lower())], "note_id string, text string")
    at = text.index("hypotension")
    gold = spans(spark, [("n", at, at + 11, 45007003)]).withColumn("seen", F.col("ord"))
    headers = H.section_headers(notes, tuple(h.lower() for h in H.CLINICAL_HEADERS))
    learned = D.section_dictionary(H.at_section(gold, headers).withColumnRenamed("header", "section"), notes)
    assert rows(learned, "section", "mention") == [("any", "hypotension"), ("past medical history:", "hypotension")]
    found = D.predict_sections(notes, headers, learned, 1, skip_prefix=0)
    assert rows(found, "start", "concept_id") == [(at, 45007003)]


def test_residual_keeps_unknown_terms(spark):
    notes = spark.createDataFrame([("n", "aaaa bbbbbb")], "note_id string, text string")
    left = S.neural_residual(spans(spark, [("n", 0, 4, 1), ("n", 5, 11, 2)]), notes, spark.createDataFrame([("aaaa", 1)], "term string, concept_id long"))
    assert rows(left, "start") == [(5,)]


def test_underlined_and_blank_line_headers(spark):
    text = "Title one\n-----\nbody\nName:\n\nbob\nPlan:\n\n====\nend"
    notes = spark.createDataFrame([("n", text)], "note_id string, text string")
    assert rows(H.line_headers(notes), "pos", "header") == [(0, "Title one"), (text.index("Name"), "Name:"), (text.index("Plan"), "Plan:")]


def brute_longest(items):
    kept = []
    for s, e, i in sorted(items, key=lambda x: (x[0] - x[1], -x[1], x[2])):
        if all(max(s, a) >= min(e, b) for a, b, _ in kept):
            kept.append((s, e, i))
    return sorted(kept)


def test_random_overlaps_against_restatements(spark):
    rng = random.Random(3)
    data = {str(n): [(s := rng.randrange(60), s + rng.randint(1, 9)) for _ in range(rng.randint(0, 25))] for n in range(25)}
    flat = [(n, s, e, 1, i) for n, items in data.items() for i, (s, e) in enumerate(items)]
    df = spark.createDataFrame(flat, SPAN)
    longest = rows(S.longest_wins(df), "note_id", "start", "end", "ord")
    assert longest == sorted((n, *x) for n, items in data.items() for x in brute_longest([(s, e, i) for i, (s, e) in enumerate(items)]))
    other = df.withColumn("start", F.col("start") + 3).withColumn("end", F.col("end") + 3)
    pairs = rows(S.overlap_join(df, other, bucket=8), "l_note_id", "l_ord", "r_ord")
    assert pairs == sorted((n, i, j) for n, items in data.items() for i, (a, b) in enumerate(items) for j, (c, d) in enumerate(items) if max(a, c + 3) < min(b, d + 3))
    touching = rows(S.overlap_join(df, other, S.inclusive_overlap, bucket=8), "l_note_id", "l_ord", "r_ord")
    assert touching == sorted((n, i, j) for n, items in data.items() for i, (a, b) in enumerate(items) for j, (c, d) in enumerate(items) if max(a, c + 3) <= min(b, d + 3))
    scan = rows(S.alternation_scan(df.withColumn("dict_ord", F.col("ord"))), "note_id", "start", "end")
    expected = []
    for n, items in data.items():
        first = {}
        for s, e in items:
            first.setdefault(s, e)
        end = -1
        for s in sorted(first):
            if s >= end:
                expected.append((n, s, first[s]))
                end = first[s]
    assert scan == sorted(expected)
    swept = rows(S.remove_overlaps(df.withColumn("any_section", F.col("ord") % 2 == 0)), "note_id", "ord")
    whole = []
    for n, items in data.items():
        order = sorted(range(len(items)), key=lambda i: (*items[i], i))
        keep = S.sweep([(*items[i], items[i][1] - items[i][0] - 0.1 * (i % 2 == 0)) for i in order])
        whole += [(n, order[k]) for k in keep]
    assert swept == sorted(whole)


def test_painting(spark):
    notes = spark.createDataFrame([("n", "a<b c")], "note_id string, text string")
    c = spark.createDataFrame([("n", 0, 3, "green"), ("n", 2, 5, "red")], "note_id string, start int, end int, class string")
    runs = P.paint(c)
    assert rows(runs, "start", "end", "class") == [(0, 2, "green"), (2, 5, "red")]
    assert P.painted_html(notes, runs).first().html == '<mark class="green">a&lt;</mark><mark class="red">b c</mark>'


def test_offset_check_raises(spark):
    notes = spark.createDataFrame([("n", "abc")], "note_id string, text string")
    bad = spans(spark, [("n", 0, 2, 1)]).withColumn("span", F.lit("bc"))
    with pytest.raises(ValueError, match="1 spans"):
        S.check_offsets(bad, notes)


def test_choices_do_not_depend_on_batches(spark):
    """Chains cut by a batch's end, chains of one span, and one long chain give what a whole note gives."""
    rng = random.Random(8)
    data = {f"n{n}": [(s := rng.randrange(90), s + rng.randint(1, 7)) for _ in range(rng.randint(0, 60))] for n in range(12)} | {"long": [(i, i + 2 + i % 2) for i in range(900)]}
    df = spans(spark, [(n, s, e, 1) for n, items in data.items() for s, e in items])
    df = df.withColumn("any_section", F.col("ord") % 3 == 0).withColumn("dict_ord", F.col("ord"))
    wanted = [rows(f(df), "note_id", "start", "end", "ord") for f in (S.longest_wins, S.remove_overlaps)] + [rows(S.alternation_scan(df), "note_id", "start", "end")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [rows(f(df), "note_id", "start", "end", "ord") for f in (S.longest_wins, S.remove_overlaps)] + [rows(S.alternation_scan(df), "note_id", "start", "end")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted
    for f in (S.longest_wins, S.remove_overlaps, S.alternation_scan):  # no list or frame for each note or chain
        plan = f(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "FlatMapGroups" not in plan
    assert [(s, e) for n, s, e, _ in wanted[0] if n == "long"] == [(s, e) for s, e, _ in brute_longest([(*x, i) for i, x in enumerate(data["long"])])]


def test_first_overlaps_equal_all_pairs(spark):
    rng = random.Random(9)
    data = {f"n{n}": [(s := rng.randrange(40), s + rng.randint(0, 5)) for _ in range(rng.randint(0, 8))] for n in range(60)}
    df = spark.createDataFrame([(n, s, e, 1, i) for n, items in data.items() for i, (s, e) in enumerate(items)], SPAN)
    want = []
    for n, items in data.items():
        pairs = [(a, i, b, c, j, d) for i, (a, b) in enumerate(items) for j, (c, d) in enumerate(items) if i != j and a <= c < b]
        want += [(n, p[0], p[2], p[3], p[5]) for p in [min(pairs, default=None)] if p]
    found = S.first_overlaps(df)
    assert rows(found, "note_id", "start1", "end1", "start2", "end2") == sorted(want) and len(want) > 20
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_chains_and_numbers_go_on_across_batches_without_a_window(spark, batch):
    rng = random.Random(batch)
    rows = sorted({(f"n{rng.randint(0, 3)}", s, s + rng.randint(1, 9)) for s in (rng.randint(0, 120) for _ in range(300))})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = S.longest_wins(spark.createDataFrame(rows, "note_id string, start int, end int").repartition(3))
        got = sorted((r.note_id, r.start, r.end, r.ord) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = []
    for note in {n for n, _, _ in rows}:
        own, kept = [(s, e, i) for i, (s, e) in enumerate((s, e) for n, s, e in rows if n == note)], []
        for s, e, i in sorted(own, key=lambda x: (x[0] - x[1], -x[1], x[2])):
            if all(max(s, a) >= min(e, b) for a, b, _ in kept):
                kept.append((s, e, i))
        wanted += [(note, *k) for k in kept]
    assert got == sorted(wanted)


def test_surfaces_in_runs(spark, monkeypatch):
    """A note's spans, and those of many notes, go through in runs, so that a kernel's memory does not grow with a batch."""
    monkeypatch.setattr(S, "RUN_SPANS", 3)
    notes = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "drei vier f\u00fcnf")], "note_id string, text string").coalesce(1)
    rows = [(n, i, i + 2, i) for n in "abc" for i in range(5)]
    found = S.with_surface(spark.createDataFrame(rows, "note_id string, start int, end int, ord int").coalesce(1), notes).collect()
    texts = {"a": "one two", "b": None, "c": "drei vier f\u00fcnf"}
    assert sorted(map(tuple, found), key=str) == sorted(((n, i, e, o, texts[n] and texts[n][i:e]) for n, i, e, o in rows), key=str)


def test_prf_exact_with_odd_rows(spark):
    """Repeated spans count once; spans of notes without gold don't count; a null among the keys equals nothing."""
    kind = "note_id string, start int, end int"
    gold = spark.createDataFrame([("a", 0, 2), ("a", 0, 2), ("a", 3, 5), ("b", 1, 2), ("b", None, 4), (None, 1, 2)], kind)
    pred = spark.createDataFrame([("a", 0, 2), ("a", 0, 2), ("a", 7, 8), ("b", None, 4), ("c", 1, 2), (None, 1, 2)], kind)
    assert tuple(E.prf_exact(gold, pred).first())[:3] == (1, 2, 4)
    assert tuple(E.prf_exact(gold.where("false"), pred).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    plan = E.prf_exact(gold, pred)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
