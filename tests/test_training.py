"""The composed runs of the dictionary on a small corpus, worked out by hand."""

from pyspark.sql import functions as F

from spanloom.operators import dictionary as D
from spanloom.operators import training as R

HEADERS = ("Plan", "Past Medical History")
PAD = "x" * 100 + "\n"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def corpus(spark):
    """Four notes: pain is right in Plan; COPD is written in capitals only; cough is wrong more often than right."""
    texts = {
        "a": PAD + "Plan:\n\nchest pain and COPD cough\n",
        "b": PAD + "Plan:\n\nchest pain cough\n",
        "c": PAD + "Past Medical History:\n\nCOPD cough cough\n",
        "d": PAD + "Past Medical History:\n\nnone cough\n",
    }
    marked = [("a", "chest pain", 1), ("a", "COPD", 2), ("a", "cough", 3), ("b", "chest pain", 1), ("c", "COPD", 2)]
    spans = [(n, texts[n].index(m), texts[n].index(m) + len(m), c, i, i, m.lower()) for i, (n, m, c) in enumerate(marked)]
    notes = spark.createDataFrame(list(texts.items()), "note_id string, text string")
    return notes, spark.createDataFrame(spans, "note_id string, start int, end int, concept_id long, ord int, seen long, mention string")


def tables(spark):
    names = spark.createDataFrame([(1, "pain of chest"), (7, "chest pain")], "concept_id long, name string")
    blacklist = spark.createDataFrame([("and",)], "word string")
    types = spark.createDataFrame([(1, "finding"), (2, "finding"), (3, "finding"), (9, "body")], "concept_id long, type string")
    return names, blacklist, types


def test_train_and_predict(spark, tmp_path):
    notes, gold = corpus(spark)
    names, blacklist, types = tables(spark)
    source = spark.createDataFrame([("any", "chest pain", 7), ("any", "and", 8), ("any", "pain of knee", 9), ("plan:", "chest pain", 5)], "section string, mention string, concept_id long")
    got = R.train(notes, gold, HEADERS, [source], names, blacklist, types, 2)
    assert rows(got.cased, "section", "mention", "concept_id") == [("Past Medical History:", "COPD", 2), ("Plan:", "COPD", 2), ("any", "COPD", 2)]
    found = {(r.section, r.mention): (r.concept_id, r.sections) for r in got.entries.collect()}
    # cough: one correct note against three wrong ones for any, one each in the plan; a concept's own name overwrites
    assert ("any", "cough") not in found and found[("plan:", "cough")] == (3, ["plan:"])
    assert found[("any", "chest pain")] == (7, None) and found[("plan:", "chest pain")] == (1, ["plan:"])
    assert found[("any", "knee pain")] == (9, None) and found[("any", "pain of the knee")] == (9, None)
    assert not any(m in ("and", "copd") for _, m in found)
    got.save(str(tmp_path / "d"))
    kept = R.Dictionaries.load(spark, str(tmp_path / "d"))
    text = PAD + "Plan:\n\nchest pain, COPD, copd, knee pain, T rising; LVEF low\n"
    fresh = spark.createDataFrame([("z", text)], "note_id string, text string")
    short = spark.createDataFrame([("any", "LVEF", 4), ("any", "T", 6)], "section string, mention string, concept_id long")
    none = spark.createDataFrame([], "general_id long, specific_id long, additional_word string, ord int")
    want = [(m, c) for m, c in (("chest pain", 1), ("COPD", 2), ("knee pain", 9), ("T rising", 105723007), ("LVEF", 4))]
    spans = R.predict(fresh, HEADERS, kept, short, none, 2)
    assert rows(spans, "start", "concept_id") == sorted((text.index(m), c) for m, c in want)


def test_build_full(spark):
    notes, gold = corpus(spark)
    names, _, types = tables(spark)
    external = R.Dictionaries(
        spark.createDataFrame([("any", "chest pain", 99), ("any", "fever", 9), ("any", "seen later", 10)], "section string, mention string, concept_id long"),
        spark.createDataFrame([("any", "COPD", 98), ("any", "MS", 11), ("any", "LATER", 12)], "section string, mention string, concept_id long"),
    )
    test = spark.createDataFrame([("seen later",), ("later",), ("chest pain",)], "mention string")
    got = R.build_full(notes, gold, test, HEADERS, external, types, 2)
    entries = {(r.section, r.mention): (r.concept_id, r.sections) for r in got.entries.collect()}
    assert entries[("any", "chest pain")] == (1, ["past medical history:", "plan:"]) and entries[("any", "fever")] == (9, None)
    assert ("any", "seen later") not in entries
    assert {("any", "COPD", 2), ("any", "MS", 11)} <= set(rows(got.cased, "section", "mention", "concept_id"))
    assert not got.cased.where(F.col("mention") == "LATER").count()
    assert D.case_sensitive_entries(spark).count() == len(D.CASE_SENSITIVE)
