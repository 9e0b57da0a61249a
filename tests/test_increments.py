"""Counts by part: replacing, forgetting and compacting against learning at once; unfinished writes count for nothing."""

import pytest

from spanloom.operators.increments import CountStore

ROWS = [("any", "pain", c, n, f) for c, n, f in ((1, 3, 0), (2, 2, 5))]
MORE = [("any", "pain", 2, 2, 9), ("plan:", "cough", 3, 1, 7), ("any", "tie", 5, 1, 8), ("any", "tie", 4, 1, 6)]
SCHEMA = "section string, mention string, concept_id long, n long, first_seen long"


def found(store, parts=None):
    return sorted(map(tuple, store.majorities(parts).select("section", "mention", "concept_id", "n", "total").collect()))


def test_parts_add_up(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "counts"))
    assert store.parts() == [] and found(store) == []
    a, b = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(MORE, SCHEMA)
    store.put("a", a)
    assert found(store) == [("any", "pain", 1, 3, 5)]
    store.put("b", b)
    whole = [("any", "pain", 2, 4, 7), ("any", "tie", 4, 1, 2), ("plan:", "cough", 3, 1, 1)]
    assert found(store) == whole and store.parts() == ["a", "b"]
    assert found(store, ["a"]) == [("any", "pain", 1, 3, 5)]
    store.put("b", b.where("concept_id <> 2"))
    assert found(store)[0] == ("any", "pain", 1, 3, 5)
    store.put("b", b)
    store.compact("all")
    assert store.parts() == ["all"] and found(store) == whole
    assert sorted(map(tuple, store.section_dictionary().collect())) == [("any", "pain", 2), ("any", "tie", 4), ("plan:", "cough", 3)]
    store.drop("all")
    assert found(store) == []


def test_unfinished_and_odd_names(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "counts"))
    store.put("a", spark.createDataFrame(ROWS, SCHEMA))
    (tmp_path / "counts" / "a@dead").mkdir()
    (tmp_path / "counts" / "a@dead" / "part-0.parquet").write_bytes(b"half")
    assert found(store) == [("any", "pain", 1, 3, 5)]
    for name in ("", "a/b", "a@b", "a=b"):
        with pytest.raises(ValueError):
            store.put(name, spark.createDataFrame(ROWS, SCHEMA))


def test_null_keys(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "counts"))
    store.put("a", spark.createDataFrame([(None, None, 1, 2, 0), (None, None, 1, 3, 1)], SCHEMA))
    assert found(store) == [(None, None, 1, 5, 5)]
