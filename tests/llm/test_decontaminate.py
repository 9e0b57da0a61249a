import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import decontaminate as D
from spanloom.llm.fm_index import FmIndex, suffix_array


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = [False] * len(w), set()
    for name, t in items:
        iw = words(t)
        for window in [iw] if 0 < len(iw) < 10 else [iw[i : i + 10] for i in range(len(iw) - 9)]:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    found.add(str(name))
                    hit[i : i + len(window)] = [True] * len(window)
    return len(w), sum(hit), sorted(found)


def test_index_against_scan():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = rng.integers(1, 5, rng.integers(0, 50))
        assert suffix_array(np.append(text, 0)).tolist() == sorted(range(len(text) + 1), key=lambda i: [*text[i:].tolist(), 0])
        index = FmIndex(text, 5, sample=3)
        for _ in range(10):
            p = rng.integers(1, 5, rng.integers(1, 4))
            low, high = index.search(np.pad(p, (5 - len(p), 0))[None])
            found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
            assert found == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_documents_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(4)
    vocabulary = ["a", "B", "é", "c9", "dd", "e_f", "x"]
    text = lambda n: rng.choice([" ", " - ", "_{"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(3, 14))) for i in range(6)] + [(6, None), (7, "..."), (1, text(12))]
    docs = [(i, text(rng.randint(0, 60)) + (" " + (rng.choice(items)[1] or "")).upper()) for i in range(60)]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(dict(docs)[r.doc_id], items)
        cut = [dict(docs)[r.doc_id][int(s) : int(e)] for s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert sum(len(words(x)) for x in cut) == r.n_hit
    # the rounds of a benchmark beyond the broadcast bound give what one round gives, spans and cut texts too
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"clean": F.lit("c"), "n_hit": F.lit(7)}), spark.createDataFrame(items, "item_id long, text string")
    carry = ("text", "clean", "n_hit")
    one = [sorted(map(str, x.collect())) for x in (D.decontaminate(df, bench, carry=carry), D.without_contamination(df, bench, carry=("clean", "n_hit")))]
    monkeypatch.setattr(D, "BLOCK_BYTES", 4 << 20)
    whole = [sorted(map(str, x.collect())) for x in (D.decontaminate(df, bench, carry=carry), D.without_contamination(df, bench, carry=("clean", "n_hit")))]
    assert one == whole


def test_runs_of_rounds_are_merged():
    runs = np.array([[5, 8, 20, 30], [0, 3, 0, 9], [3, 4, 10, 14], [6, 7, 23, 26], [9, 10, 35, 40]])
    assert D.merged(runs).tolist() == [[0, 4, 0, 14], [5, 8, 20, 30], [9, 10, 35, 40]]
    assert D.merged(np.zeros((0, 4), np.int64)).tolist() == []


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat")], "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(edge_docs, items).collect()}
    assert got[1].n_words == 0 and got[3].n_hit == got[3].n_words == 24000
    assert D.decontaminate(no_docs, items).count() == 0
    assert {r.n_hit for r in D.decontaminate(edge_docs, items.where("false")).collect()} == {0}
    assert D.without_spans("ab cd ef", "3:5") == "ab  ef"


def test_clashing_columns_and_items_without_an_id(spark, edge_docs):
    words = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, words), ("null", "a " * 12)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {words} y", "c")], "doc_id long, text string, clean string")
    got = D.without_contamination(docs, bench, carry=("clean",)).collect()[0]
    assert got.clean.split() == ["x", "y"] and got.clean_carried == "c"
    assert D.decontaminate(docs, bench).collect()[0].items == [""]
    assert D.without_contamination(edge_docs, bench, carry=("clean", "spans")).count() == 9


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rng = random.Random(piece)
    items = [("a", "é b c9"), ("b", "x " * 12)]
    block = type("Block", (), {"value": D.Phrases([(n, t.encode()) for n, t in items])})()
    texts = ["", " ", "é", "É b c9", "x" * 30] + ["".join(rng.choice(["é b c9", " x", " ", "_", "x x ", "ü"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    columns = D.scan_shard([t.encode() for t in texts], [block])
    for text, n, hit, found, spans in zip(texts, *columns, strict=True):
        assert (n, hit, found) == brute(text, items)
        cut = [text[int(s) : int(e)] for s, e in (x.split(":") for x in spans.split(",") if x)]
        assert sum(len(words(x)) for x in cut) == hit and all(words(x[0]) and words(x[-1]) for x in cut)
        assert words(D.without_spans(text, spans)) == words(text) if not hit else True
