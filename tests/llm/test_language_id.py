import zlib

import numpy as np
from spanloom.llm import language_id as L


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    m = L.ByteGru(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rows, label = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    grad = m.train_step(rows, label)[1]
    for k, p in m.p.items():
        for _ in range(5):
            at = (rng.integers(2), rows.ravel()[rng.integers(24)], rng.integers(9)) if k == "x" else tuple(rng.integers(s) for s in p.shape)
            old, near = p[at], []
            for e in (1e-3, -1e-3):
                p[at] = old + e
                near.append(m.train_step(rows, label)[0])
            p[at] = old
            assert abs((near[0] - near[1]) / 2e-3 - grad[k][at]) < 2e-4


def test_batched_windows_equal_single_steps():
    m = L.ByteGru(["a", "b"], hidden=4)
    texts = [b"", b"x", bytes(range(256)) * 3, b"abc" * 50]
    whole = m.probabilities(texts)
    for t, row in zip(texts, whole, strict=True):
        assert np.allclose(m.probabilities([t])[0], row, atol=1e-5)
        assert len(m.position_labels(t)) == len(t)
    assert np.allclose(whole[1:].sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy_and_contract(spark, prose):
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string, n_chars long")
    got = L.identify(df).collect()
    truth = {d[0]: d[2] for d in prose}
    assert len(got) == len(prose)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(edge_docs, no_docs):
    got = {r.doc_id: r for r in L.identify(edge_docs).collect()}
    assert [got[i].lang_pred for i in (1, 2, 6)] == ["und"] * 3 and got[1].score == 0
    assert got[3].lang_pred in ("en", "fr") and got[None].held_out is False
    assert L.identify(no_docs).count() == 0
    assert L.train(no_docs) is None
    unlabelled = edge_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


def test_only_letters_count_as_letters(spark, prose):
    df = spark.createDataFrame([*prose, (900, "\u00bd \u00b2 12", None, "s", 0), (901, "\u2460 \u2167_", None, "s", 0), (902, "\u0416", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert [got[i].lang_pred for i in (900, 901)] == ["und", "und"] and got[900].score == got[901].score == 0
    assert got[902].lang_pred in ("aa", "bb")


def test_every_label_is_learned_and_bounds_are_arguments(spark):
    rows = [(i, f"text number {i} of label {i % 300}", f"l{i % 300:03}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(L.train(df, rows=10, passage=80, windows=1).labels) == 300
    few = L.train(df, most=900, passage=80, windows=1).labels
    assert 200 < len(few) <= 300


def test_result_does_not_depend_on_neighbours():
    m = L.ByteGru(["a", "b", "c"], hidden=8)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, int(n)).tolist()) for n in rng.integers(1, 900, 40)]
    whole = np.round(m.probabilities(texts), L.SCORE_DIGITS)
    assert all((np.abs(np.round(m.probabilities([t])[0], L.SCORE_DIGITS) - row) <= 1.01e-5).all() for t, row in zip(texts, whole, strict=True))
