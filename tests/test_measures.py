"""Character counts by note and linking by vector against plainer ways."""

import random

from pyspark.sql import functions as F

from spanloom.operators import evaluate as E
from spanloom.operators import vectors as V

SPAN = "note_id string, start int, end int, concept_id long, ord int"


def by_character(gold, pred):
    """concept_id -> n_both, n_either, a character at a time; of several spans the one with the highest ord counts."""
    painted = []
    for side in (gold, pred):
        out = {}
        for n, s, e, c, _ in sorted((r for r in side if r[0] is not None), key=lambda r: r[4]):
            out |= {(n, i): c for i in range(s, e)}
        painted.append(out)
    g, p = painted
    concepts = {r[3] for r in gold + pred if r[3] is not None}
    same = {c: sum(v == c == p.get(k) for k, v in g.items()) for c in concepts}
    return {c: (same[c], sum(v == c for v in g.values()) + sum(v == c for v in p.values()) - same[c]) for c in concepts}


def test_char_iou_by_note(spark, monkeypatch):
    """Overlapping, empty and far spans, null concepts and notes of one side; no row for a character."""
    rng = random.Random(1)
    some = lambda n: [(rng.choice(["a", "b", "c", str(i % 30)]), s := rng.randrange(80), s + rng.randrange(9), rng.choice([1, 2, 3, None]), i) for i in range(n)]
    gold, pred = [*some(300), ("far", 2_000_000_000, 2_000_000_007, 9, 1), (None, 0, 5, 1, 2)], some(250)
    g, p = (spark.createDataFrame(x, SPAN).repartition(3).localCheckpoint() for x in (gold, pred))
    for size in (1, 1 << 16):
        monkeypatch.setattr(E.S, "RUN_SPANS", size)
        found = E.char_iou(g, p)
        got = {r.concept_id: (r.n_both, r.n_either) for r in found.collect() if r.concept_id is not None}
        assert got == by_character(gold, pred) and got[9] == (0, 7)
    assert "sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert E.mean_char_iou(g, p.where("false")).first()[0] == 0.0 and E.char_iou(g.where("false"), p.where("false")).count() == 0


def test_concept_overwritten_everywhere(spark):
    """Its spans have no character left on either side: 0, not an error."""
    g = spark.createDataFrame([("a", 0, 4, 1, 0), ("a", 0, 5, 2, 1)], SPAN)
    assert {tuple(r) for r in E.char_iou(g, g).collect()} == {(1, 0, 0, 0.0), (2, 5, 5, 1.0)}


def test_whole_notes():
    import pyarrow as pa

    note = [0, 0, 0, 1, 2, 2, 3, 3, 3, 3, 4]
    for size in (1, 3, 20):
        for cut in (1, 2, 5):
            parts = [pa.record_batch({"note_id": [str(x) for x in note[i : i + cut]]}) for i in range(0, len(note), cut)]
            got = [b.column(0).to_pylist() for b in E.S.whole_notes(iter(parts), size)]
            assert sum(got, []) == [str(x) for x in note] and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def test_link_by_vector(spark):
    """Mentions that name a shared vector are linked as those that carry it; no mention carries it."""
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(12)], "vec_id long, embedding array<double>").localCheckpoint()
    concepts = spark.createDataFrame([(100 + i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(20)], "label long, class int, embedding array<double>")
    rows = [(str(i % 9), i, i * 10, i * 10 + rng.randrange(1, 8), rng.choice(["left", "abc", "abd", "zz"]), rng.randrange(2), rng.choice([None, "medication:", "plan:"]), rng.randrange(14)) for i in range(120)]
    mentions = spark.createDataFrame(rows, "note_id string, ord int, start int, end int, surface string, class int, header string, vec_id long").localCheckpoint()
    train, dictionary = spark.createDataFrame([(103,), (110,)], "concept_id long"), spark.createDataFrame([("abc", 5)], "key string, concept_id long")
    static = spark.createDataFrame([("1", 2, 6, 7, 0), ("2", 0, 900, 7, 0)], "note_id string, start int, end int, concept_id long, ord int")
    want = V.link(mentions.join(vectors, "vec_id"), concepts, train, dictionary, static, ("medication:",))
    got = V.link(mentions, concepts, train, dictionary, static, ("medication:",), vectors)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
