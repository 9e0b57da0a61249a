import math

import numpy as np
from pyspark.sql import functions as F

import pytest
from spanloom.functions import text as T
from spanloom.operators import corpus as C
from spanloom.operators import dictionary as D
from spanloom.operators import evaluate as E
from spanloom.operators import graph as G
from spanloom.operators import sections as H
from spanloom.operators import tags as N
from spanloom.operators import terminology as A
from spanloom.operators import vectors as V
from spanloom.sources import files
from spanloom.streaming import match


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.mark.parametrize(("text", "expected"), [("Heart (organ)", "heart"), ("[D] Pain NOS", "pain nos"), ("plain", "plain"), ("A (b) (c)", "a (b)")])
def test_process_term(spark, text, expected):
    assert one(spark, T.process_term("t"), t=text) == expected


def test_scalars(spark):
    assert one(spark, T.collapse_ws("t"), t=" a \n b ") == "a b"
    assert one(spark, T.normalize_keep_len("t"), t="É-a1") == "  a1"
    assert one(spark, T.single_space_offset("t", F.lit(4)), t="a   b") == 2
    assert one(spark, T.levenshtein_similarity("a", "b"), a=" Kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, T.restore_lines(T.one_line("t")), t="a\nb") == "a\nb" and one(spark, T.one_line("t"), t="a\r\nb\tc") == "a\\nb c"


def test_bio_decoders(spark):
    t = spark.createDataFrame([("n", 0, 0, 3, "B-a", 0.5), ("n", 1, 4, 6, "I-a", 1.0), ("n", 2, 7, 8, "I-b", 1.0), ("n", 3, 9, 10, "I-b", 1.0), ("n", 4, 20, 22, "B-b", 1.0), ("n", 5, 22, 23, "B-b", 0.0), ("n", 6, 24, 25, "O", 1.0)], "note_id string, ord int, start int, end int, tag string, conf double")
    assert rows(N.bio_decode(t), "start", "end", "cls") == [(0, 6, "a"), (7, 8, "b"), (9, 10, "b"), (20, 22, "b"), (22, 23, "b")]
    assert rows(N.bio_decode_merging(t), "start", "end", "cls", "confidence") == [(0, 6, "a", 0.75), (7, 10, "b", 1.0), (20, 23, "b", 0.5)]
    assert N.label_ids(["x", "y"]) == {"O": 0, "B-x": 1, "I-x": 2, "B-y": 3, "I-y": 4}


def test_tagger_plug_in(spark):
    notes = spark.createDataFrame([("n", "ab")], "note_id string, text string")
    tagged = N.tag_with(notes, lambda: lambda texts: [[(0, len(t), "B-x", 1.0)] for t in texts])
    assert rows(tagged, "note_id", "start", "end", "tag") == [("n", 0, 2, "B-x")]


def test_windows_and_crops(spark):
    t = spark.createDataFrame([("n", i, i) for i in range(7)], "note_id string, ord int, id int")
    w = N.token_windows(t, 5, ["id"])
    assert rows(w, "chunk", "id") == [(0, [0, 1, 2]), (1, [3, 4, 5]), (2, [6])]
    s = N.with_special(w.withColumn("labels", F.col("id")), "id", "labels", 101, 102).where("chunk = 2").first()
    assert (s.id, s.labels, s.attention_mask) == ([101, 6, 102], [-100, 6, -100], [1, 1, 1])
    assert rows(N.halves(w.where("chunk = 0"), "id"), "half", "id") == [(0, [0]), (1, [1, 2])]
    assert len(N.crop(w, "id", 2, True).first().id) == 2


def test_graph_closures(spark):
    e = spark.createDataFrame([(2, 1, G.IS_A), (3, 1, G.IS_A), (4, 2, G.IS_A), (4, 3, G.IS_A), (5, 4, G.IS_A), (1, 5, 7)], "src long, dst long, type long").withColumn("group", F.lit(0))
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(G.descendants(e, start), "node", "hops") == [(2, 1), (3, 1), (4, 2), (5, 3)]
    assert rows(G.descendants(e, start, 1), "node") == [(2,), (3,)]
    assert rows(G.ancestors(e, spark.createDataFrame([(5,)], "node long"), root=1), "node") == [(2,), (3,), (4,)]
    assert G.shortest_path(e, 5, 1).first().path == [5, 4, 2, 1]
    assert G.shortest_path(e, 3, 99).count() == 0
    with pytest.raises(ValueError, match="positive"):
        G.descendants(e, start, 0)


def test_graph_from_tables(spark):
    d = spark.createDataFrame([(1, "Root (x)", G.FSN, 1, 0), (1, "root", G.SYNONYM, 1, 1), (2, "leaf", G.SYNONYM, 1, 2), (3, "alone", G.FSN, 1, 3)], "conceptId long, term string, typeId long, active int, ord int")
    r = spark.createDataFrame([(2, 1, G.IS_A, 0, 1, 0), (2, 1, 7, 1, 1, 1)], "sourceId long, destinationId long, typeId long, relationshipGroup int, active int, ord int")
    nodes, edges = G.from_tables(d, r)
    assert rows(nodes, "sctid", "fsn") == [(1, "Root (x)"), (2, "leaf")] and edges.count() == 2
    assert rows(G.from_tables(d, r, collapse=True)[1], "type") == [(7,)]


def test_mixup_radius(spark):
    radius = V.mixup_radius(spark.createDataFrame([(2.0, 0.5, 4)], "r double, v double, d int"), 0.7, 1.0).first().radius
    assert radius == pytest.approx(2.0 * math.sqrt((0.49 / 0.09 - 1) / 2))


def test_invalid_vectors_go(spark):
    v = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, float("inf")]), (3, [1.0, 2.0]), (4, None)], "label long, embedding array<double>")
    assert rows(V.drop_invalid(v), "label") == [(3,)]


def test_mixup_is_reproducible(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "k long, embedding array<double>, label int")
    a, b = (V.mixup(v, "k", 0.5, 2).orderBy("k").collect() for _ in range(2))
    assert a == b and all(abs(sum(r.targets) - 1) < 1e-9 for r in a)


def test_pruning(spark):
    gold = spark.createDataFrame([("n", 0, 4, 1, 0), ("n", 10, 14, 2, 1)], "note_id string, start int, end int, concept_id long, ord int")
    hits = spark.createDataFrame([("n", 0, 4, 1, "any", "aaaa", 0), ("n", 10, 14, 3, "any", "bbbb", 1), ("n", 20, 24, 9, "any", "cccc", 2)], "note_id string, start int, end int, concept_id long, section string, dict_entry string, ord int")
    assert rows(D.score_hits(hits, gold), "start", "score") == [(0, 1), (10, -1), (20, -1)]
    entries = spark.createDataFrame([("any", "aaaa", 1), ("any", "bbbb", 3)], "section string, mention string, concept_id long")
    assert rows(D.remove_bad_keys(entries, D.key_scores(D.score_hits(hits, gold))), "mention") == [("aaaa",)]
    greedy = D.greedy_keys(spark.createDataFrame([(1, "any", "good", 9, 0), (1, "any", "bad", 1, 9)], "concept_id long, section string, dict_entry string, n_correct long, n_incorrect long"), spark.createDataFrame([(1, 5)], "concept_id long, n long"))
    assert rows(greedy, "dict_entry", "bad") == [("bad", True), ("good", False)]


def test_greedy_keys_in_order(spark):
    """By falling ratio: 8/0.01, 3/2.01, 2/4.01, 1/4.01, 1/20.01; the running score falls with each key that is kept."""
    keys = [(1, "any", "a", 8, 0), (1, "any", "b", 3, 2), (1, "x", "c", 2, 4), (1, "any", "d", 1, 4), (1, "any", "e", 1, 20), (2, "any", "f", 0, 5)]
    scores = spark.createDataFrame(keys, "concept_id long, section string, dict_entry string, n_correct long, n_incorrect long")
    counts = spark.createDataFrame([(1, 10), (2, 3)], "concept_id long, n long")
    correct = incorrect = 0
    want = []
    for at, (c, section, entry, good, bad) in enumerate(keys[:5]):
        share = (0.3 if section == "any" else 0.2) * (2 if at > 2 else 1)
        keep = correct / (incorrect + 10) < good / (bad + 0.01) or good >= (1 if good == 1 else share) * bad
        correct, incorrect = correct + good * keep, incorrect + bad * keep
        want.append((entry, not keep))
    assert rows(D.greedy_keys(scores, counts), "dict_entry", "bad") == sorted([*want, ("f", True)])


def test_abbreviation_takes_its_first_row(spark):
    abbr = spark.createDataFrame([("copd", 9, 0), ("copd", 3, 1), ("mi", 1, 2)], "abbreviation string, concept_id long, ord long")
    assert rows(A.abbreviation_dictionary(abbr), "section", "mention", "concept_id") == [("any", "copd", 9)]


def test_growing(spark):
    k = spark.createDataFrame([("any", "pain of chest", 1, 0), ("any", "a and b", 2, 1)], "section string, mention string, concept_id long, ord long")
    black = spark.createDataFrame([("zz",)], "word string")
    made = {r.mention: r.concept_id for r in D.word_permutations(k, black).collect()}
    assert made["chest pain"] == 1 and made["b a and"] == 2
    assert ("a with b", 2) in rows(D.word_replacements(k), "mention", "concept_id")
    upper = D.uppercase_mentions(spark.createDataFrame([("COPD",), ("COPD",), ("Pain",)], "source_orig string"), spark.createDataFrame([("any", "copd", 1), ("any", "pain", 2)], "section string, mention string, concept_id long"))
    assert rows(upper, "section", "mention") == [("any", "COPD")]
    sections = spark.createDataFrame([("history of present illness:",), ("other",), ("nonsense:",)], "section string")
    assert rows(sections.select("section", D.cased_section(F.col("section"), H.CLINICAL_HEADERS).alias("cased")), "section", "cased") == [("history of present illness:", "History of Present Illness:"), ("nonsense:", "any"), ("other", "other")]
    assert rows(D.merge_external(k.select("section", "mention", "concept_id"), spark.createDataFrame([("any", "new", 5), ("any", "held", 6)], "section string, mention string, concept_id long"), spark.createDataFrame([("held",)], "mention string")), "mention") == [("a and b",), ("new",), ("pain of chest",)]


def test_specialise_and_extensions(spark):
    notes = spark.createDataFrame([("n", "severe left knee and knee")], "note_id string, text string")
    s = spark.createDataFrame([("n", 12, 16, 1, 0), ("n", 21, 25, 1, 1)], "note_id string, start int, end int, concept_id long, ord int")
    e = spark.createDataFrame([(1, 2, "left", 0)], "general_id long, specific_id long, additional_word string, ord int")
    assert rows(A.specialise(s, notes, e), "start", "end", "concept_id") == [(7, 16, 2), (21, 25, 1)]
    p = spark.createDataFrame([(2, "Left knee (body structure)", 1, "Knee (body structure)"), (3, "Left big knee (x)", 1, "Knee (x)")], "src long, src_name string, dst long, dst_name string")
    assert rows(A.term_extensions(p), "specific_id", "additional_word") == [(2, "left")]
    with pytest.raises(ValueError, match="repeats"):
        A.many_to_one(e, e.unionByName(e), ["general_id"])


def test_terminology_chain(spark):
    c = spark.createDataFrame([(1, 1), (2, 0)], "id long, active int")
    d = spark.createDataFrame([(1, "Pain (finding)", A.FSN, 1), (1, "pain", A.SYNONYM, 1), (2, "Old (finding)", A.FSN, 1)], "conceptId long, term string, typeId long, active int")
    t = A.load_terminology(c, d)
    assert rows(A.flattened_terminology(t)) == [(1, "Pain (finding)", "finding")]
    named = A.synonym_dictionary(spark.createDataFrame([(1, "Bad pain", 0), (9, "one", 1)], "concept_id long, concept_name string, ord long"), spark.createDataFrame([(2, "Bad pain (finding)", 0)], "concept_id long, concept_name string, ord long"))
    assert rows(named) == [("any", "bad pain", 2)]


def test_corpus(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "k long")
    assert rows(C.dense_ids(d, ["k"]), "k", "annotation_id") == [(i, i + 1) for i in range(10)]
    assert sorted(r["count"] for r in C.exact_folds(d, "k", [7, 2, 1]).groupBy("fold").count().collect()) == [1, 2, 7]
    with pytest.raises(ValueError, match="10 rows"):
        C.exact_folds(d, "k", [1])
    a = spark.createDataFrame([("r", None, "T")], "report string, full_text string, text string")
    assert rows(C.unify_documents([a], ["full_text", "text"], ["report"], ["label"]), "report", "full_text", "doc_label") == [("r", "T", "")]


def test_sections_cut(spark):
    n = spark.createDataFrame([("n", "aa: 12 bb: 345 cc: 6")], "note_id string, text string")
    s = spark.createDataFrame([("n", 4, 6), ("n", 11, 14), ("n", 19, 20)], "note_id string, start int, end int")
    notes, kept = H.cut_sections(n, s, ("aa:", "bb:", "cc:"), ("bb:",))
    assert notes.first().text == "aa: 12 cc: 6" and rows(kept, "start", "end") == [(4, 6), (11, 12)]


def test_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text('id\teffectiveTime\tactive\tmoduleId\tdefinitionStatusId\n1\t2\t1\t3\t4\n5\t2\t0\t3\t4\n')
    assert rows(files.read_rf2(spark, str(tmp_path / "d.txt"), files.CONCEPT), "id") == [(1,)]
    df = spark.createDataFrame([("n", 'a "q"\nb\tc')], "note_id string, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_notes(spark, str(tmp_path / "c")).first().text == 'a "q"\nb\tc'
    files.write_csv_oneline(df, str(tmp_path / "o"))
    assert files.read_csv_oneline(spark, str(tmp_path / "o"), "note_id string, text string", ["text"]).first().text == 'a "q"\nb c'
    files.write_jsonl(df.withColumn("z", F.lit(None).cast("int")), str(tmp_path / "j"))
    assert '"z":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    built = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), lambda: built.append(1) or df).count() == 1
    assert built == [1]
    files.save_graph(df, df, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g"))[0].count() == 1


def test_stream_matches_notes(spark, tmp_path):
    spark.createDataFrame([("n1", "chest pain"), ("n2", "none")], "note_id string, text string").write.parquet(str(tmp_path / "in"))
    lexicon = spark.createDataFrame([("chest pain", 5)], "term string, concept_id long")
    notes = spark.readStream.schema("note_id string, text string").parquet(str(tmp_path / "in"))
    q = match.match_stream(notes, lexicon, 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "note_id", "start", "end", "concept_id") == [("n1", 0, 10, 5)]


def test_annotate_by_patterns(spark):
    text = "x" * 100 + "\nPlan:\n\nHas chest  pains, x-ray (left) and MRIs; xchest pain.\nService:\n\nchest pain\n"
    notes = spark.createDataFrame([("n", text)], "note_id string, text string")
    low = notes.withColumn("text", F.lower("text"))
    headers = H.section_headers(low, ("plan", "service"))
    d = spark.createDataFrame([("any", "chest pain", 1), ("plan:", "x ray (left)", 2), ("plan:", "x-ray (left)", 3), ("other:", "mri", 4), ("plan:", "mri", 5)], "section string, mention string, concept_id long")
    got = rows(D.annotate(notes, headers, d, 3), "start", "end", "concept_id")
    at = lambda s: text.index(s)
    assert got == [(at("chest  pains"), at("chest  pains") + 12, 1), (at("x-ray"), at("x-ray") + 12, 3), (at("MRIs"), at("MRIs") + 4, 5)]
    cased = spark.createDataFrame([("any", "MRI", 7)], "section string, mention string, concept_id long")
    none = spark.createDataFrame([], "general_id long, specific_id long, additional_word string, ord int")
    both = D.make_predictions(notes, headers, headers, d, cased, none, 3)
    assert rows(both, "concept_id") == [(1,), (3,), (5,)]


def test_add_external(spark):
    base = spark.createDataFrame([("any", "pain of chest", 1)], "section string, mention string, concept_id long")
    more = spark.createDataFrame([("any", "pain of chest", 2), ("any", "black", 3), ("any", "knee", 4)], "section string, mention string, concept_id long")
    names = spark.createDataFrame([(2, "other")], "concept_id long, name string")
    got = dict(rows(D.add_external(base, [more], names, spark.createDataFrame([("black",)], "word string")), "mention", "concept_id"))
    assert {"pain of chest": 1, "knee": 4, "chest pain": 1, "pain of the chest": 1}.items() <= got.items() and "black" not in got


def test_windowed_hits(spark, tmp_path):
    rows_ = [("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 1), ("2024-01-01 00:06:00", 2)]
    spark.createDataFrame(rows_, "t string, concept_id long").selectExpr("CAST(t AS TIMESTAMP) AS ts", "concept_id").write.parquet(str(tmp_path / "in"))
    hits = spark.readStream.schema("ts timestamp, concept_id long").parquet(str(tmp_path / "in"))
    q = match.hits_per_window(hits).writeStream.outputMode("complete").format("memory").queryName("hit_windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT date_format(window.start, 'HH:mm') AS w, concept_id, n FROM hit_windows")
    assert rows(got) == [("00:00", 1, 2), ("00:05", 2, 1)]


def test_specialise_behind(spark):
    text = "knee left, Left\nknee  right knee L"
    notes = spark.createDataFrame([("n", text)], "note_id string, text string")
    spans = [("n", 0, 4, 1, 0), ("n", 16, 20, 1, 1), ("n", 28, 32, 1, 2)]
    s = spark.createDataFrame(spans, "note_id string, start int, end int, concept_id long, ord int")
    e = spark.createDataFrame([(1, 2, "left", 0), (1, 3, "right", 1)], "general_id long, specific_id long, additional_word string, ord int")
    assert rows(A.specialise(s, notes, e), "start", "end", "concept_id") == [(0, 4, 1), (11, 20, 2), (22, 32, 3)]
    # behind the first span "left," is no form and "Left", the second word, is one: the concept changes, the span doesn't grow
    assert rows(A.specialise(s, notes, e, after=True), "start", "end", "concept_id") == [(0, 4, 2), (11, 20, 2), (22, 32, 3)]
    one = spark.createDataFrame([("n", 22, 26, 1, 0)], "note_id string, start int, end int, concept_id long, ord int")
    behind = spark.createDataFrame([("n", "chest and abdomen right side")], "note_id string, text string")
    at = one.withColumns({"start": F.lit(10), "end": F.lit(17)})
    assert rows(A.specialise(at, behind, e, before=False, after=True), "start", "end", "concept_id") == [(10, 23, 3)]


def test_precision_view(spark):
    scored = spark.createDataFrame([("plan:", "pain", 1), ("plan:", "pain", -1), ("plan:", "pain", 1)], "section string, dict_entry string, score int").withColumn("note_id", F.lit("n"))
    hits = spark.createDataFrame([("Plan: ", "PAIN", 0), ("any", "pain", 1)], "section string, dict_entry string, at int")
    assert rows(D.precision_view(hits, scored), "at", "score", "seen_in_train") == [(0, 0.67, True), (1, 1.0, False)]


def test_one_vs_one_auc(spark):
    random = np.random.default_rng(3)
    data = [(int(y), [round(float(v), 1) for v in random.random(3)]) for y in random.integers(0, 3, 60)]
    df = spark.createDataFrame(data, "y int, p array<double>")
    pairs = [[float((p[a] > q[a]) + (p[a] == q[a]) / 2) for y, p in data if y == a for z, q in data if z == b] for a in range(3) for b in range(3) if a != b]
    assert E.one_vs_one_auc(df, "y", "p", 3).first().auc == pytest.approx(np.mean([np.mean(x) for x in pairs]))
    assert E.one_vs_one_auc(df.where("y < 2"), "y", "p", 3).first().auc is None


def test_abbreviations_are_distinct_without_shuffling_the_result(spark):
    from spanloom.operators import terminology as A

    abbr = spark.createDataFrame([("BP", "Blood Pressure"), ("BP", "Blood Pressure"), ("HR", "heart rate"), ("XX", "unknown")], "abbreviation string, meaning string")
    names = [(1, "blood pressure", 0), (2, "blood pressure", 1), (2, "blood pressure", 2), (3, "heart rate (obs)", 3), (4, "heart rate", 4)]
    found = A.abbreviations(abbr, spark.createDataFrame(names, "concept_id long, concept_name string, ord int"))
    assert sorted(tuple(r) for r in found.collect()) == [("BP", "Blood Pressure", 1, "blood pressure"), ("BP", "Blood Pressure", 2, "blood pressure"), ("HR", "heart rate", 3, "heart rate (obs)")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
