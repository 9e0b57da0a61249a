import re
from pathlib import Path

import corpus_pipeline as P
import pytest
from spanloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    docs = [*prose, (500, prose[10][1], "bb", "s", 0), (501, None, None, None, None), (502, "12 34", "aa", "s", 5), (503, f"{prose[3][1]} {passage} {prose[5][1]}", None, "s", 0), (504, f"{prose[7][1]} mail me at some.one9@mail.example.com", "aa", "s", 0), (505, f"{prose[7][1][: len(prose[7][1]) // 3]} {prose[9][1][: len(prose[9][1]) // 3]} mail me at some.one9@mail.example.com", "aa", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert tuple(docs.columns) == P.COLUMNS
            assert all(r.n_chars == len(r.text) for r in seen[name].values() if name in ("decontaminate", "personal_data"))
    assert not {501, 502} & set(seen["language"]) and len(seen["language"]) == 164
    assert seen["language"][503].lang is not None
    assert 500 not in seen["near_dedup"] and 10 in seen["near_dedup"]
    # 40 of 44 shingles are those of document 7: similarity 0.909, a near copy by the stage's 0.8
    assert 504 not in seen["near_dedup"] and 7 in seen["near_dedup"]
    assert "epsilon" not in seen["decontaminate"][503].text and seen["decontaminate"][3].text == seen["near_dedup"][3].text
    assert "[EMAIL]" in seen["personal_data"][505].text and "some.one9@" not in seen["personal_data"][505].text
    last = seen[P.STAGES[-1][0]]
    assert set(last) == set(seen["near_dedup"]) and all(len(r.ids) == r.n_tokens for r in last.values())
    assert {(r.doc_id, r.ids_sha256) for r in P.run(spark, folder).collect()} == {(i, r.ids_sha256) for i, r in last.items()}


def test_empty_documents(spark, no_docs, folder, tmp_path):
    docs = no_docs
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    root = Path(P.__file__).parent
    for f in (root / "spanloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
