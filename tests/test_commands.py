"""The command line runs on small files."""

import csv

from spanloom import __main__ as M
from spanloom.operators import dictionary as D

PAD = "x" * 100 + "\n"


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_score(spark, tmp_path, capsys):
    header = ["note_id", "start", "end", "concept_id"]
    gold = write(tmp_path / "g.csv", header, [("a", 0, 4, 1), ("a", 2, 4, 2), ("b", 0, 2, 1)])
    pred = write(tmp_path / "p.csv", header, [("a", 0, 4, 1)])
    # concept 1: two characters of six, for the later row of a overwrites two; concept 2: none
    M.main(["score", "--gold", gold, "--pred", pred])
    assert capsys.readouterr().out.split() == ["char_iou:", f"{(2 / 6) / 2:.4f}", "note_jaccard:", "0.5000"]


def test_review_queue(spark, tmp_path):
    rows = [("n", i, r, hit) for i, (r, hit) in enumerate([("ACCORD", True), ("CONFLIT", False), ("AUCUN", False)])]
    spark.createDataFrame(rows, "note_id string, ord int, regime string, oracle_hit boolean").write.parquet(str(tmp_path / "a"))
    report = M.review_queue(spark, str(tmp_path / "a"), str(tmp_path / "out"))
    assert "| CONFLIT | yes | 1 | 1 | 1.000 | 50.0 |" in report
    assert spark.read.csv(str(tmp_path / "out/queue"), header=True).count() == 3
    assert spark.read.text(str(tmp_path / "out/report")).count() == len(report.rstrip("\n").split("\n"))


def test_train_and_predict(spark, tmp_path):
    text = PAD + "Allergies:\n\nchest pain, none\n"
    at = text.index("chest")
    notes = write(tmp_path / "n.csv", ["note_id", "text"], [("a", text), ("b", text)])
    gold = write(tmp_path / "g.csv", ["note_id", "start", "end", "concept_id"], [("a", at, at + 10, 1), ("b", at, at + 10, 1)])
    more = write(tmp_path / "s.csv", ["section", "mention", "concept_id"], [(D.ANY, "knee pain", 2)])
    names = write(tmp_path / "names.csv", ["concept_id", "name"], [(1, "chest pain")])
    types = write(tmp_path / "types.csv", ["concept_id", "type"], [(1, "finding"), (2, "finding")])
    M.main(["train", "--notes", notes, "--annotations", gold, "--out", str(tmp_path / "d"), "--names", names, "--types", types, "--sources", more])
    fresh = PAD + "Allergies:\n\nknee pain and chest  pain\n"
    fresh_notes = write(tmp_path / "f.csv", ["note_id", "text"], [("z", fresh)])
    M.main(["predict", "--notes", fresh_notes, "--dictionaries", str(tmp_path / "d"), "--out", str(tmp_path / "p")])
    got = sorted(tuple(map(int, r[1:])) for r in spark.read.csv(str(tmp_path / "p"), header=True).collect())
    assert got == [(fresh.index("knee"), fresh.index("knee") + 9, 2), (fresh.index("chest"), len(fresh) - 1, 1)]


def test_holdout(spark, tmp_path):
    header = ["note_id", "start", "end", "concept_id"]
    text = "chest pain with cough and fever"
    notes = write(tmp_path / "n.csv", ["note_id", "text"], [("a", text)])
    at = lambda m, c: ("a", text.index(m), text.index(m) + len(m), c)
    gold = write(tmp_path / "g.csv", header, [at("chest pain", 1), at("cough", 2), at("fever", 3)])
    d = write(tmp_path / "d.csv", header, [at("chest pain", 1), at("cough", 9)])
    s = write(tmp_path / "s.csv", header, [at("cough", 2), at("fever", 3)])
    static = write(tmp_path / "t.csv", ["term", "concept_id"], [("fever", 3)])
    report = M.holdout(spark, notes, gold, d, s, static, str(tmp_path / "out"))
    # the residual lacks fever, which the static vocabulary knows
    assert report.count("| recall_oracle | 1.0000 |") == 1 and report.count("| recall_oracle | 0.6667 |") == 1
    assert "| CONFLIT | 1 | 33.3 | 0.000 |" in report and "| AUCUN | 1 | 33.3 | 1.000 |" in report
    rows = {r.metric: float(r.value) for r in spark.read.csv(str(tmp_path / "out/b/metrics"), header=True).collect()}
    assert rows["recall_d"] == rows["recall_s"] and abs(rows["delta_recall"] - 1 / 3) < 1e-9
