"""Runs from the command line: `python -m spanloom COMMAND --help`. Paths may lie on any file system that Spark knows."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionary as D
from .operators import evaluate as E
from .operators import sections as H
from .operators import spans as S
from .operators import training as R
from .operators.shared import cut_lineage
from .sources import files

KEYS = "section string, mention string, concept_id bigint"


def spans(spark: SparkSession, path: str) -> DataFrame:
    """note_id, start, end, concept_id of a CSV file with `ord`, the place of the row in its file."""
    return files.read_spans(spark, path).withColumn("ord", F.monotonically_increasing_id())


def score(spark: SparkSession, gold: str, pred: str) -> dict[str, float]:
    """Macro character IoU over concepts, and the mean Jaccard of concept sets over notes that both have; 0 without any."""
    g, p = spans(spark, gold), spans(spark, pred)
    jaccard = E.note_jaccard(g, p).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0))).first()[0]
    return {"char_iou": E.mean_char_iou(g, p).first()[0], "note_jaccard": jaccard}


def review_queue(spark: SparkSession, aligned: str, out: str, per_regime: int = 2) -> str:
    """Of stored alignments (note_id, ord, regime, oracle_hit, others): the rows with their queue flag, the metrics, the table by
    regime, examples and a Markdown report, each in a folder of `out`; returns the report."""
    rows = spark.read.parquet(aligned)
    metrics, by_regime = E.queue_metrics(rows), E.queue_by_regime(rows)
    for name, df in (("queue", E.add_queue_flag(rows)), ("metrics", metrics), ("by_regime", by_regime), ("examples", E.sample_examples(rows, per_regime))):
        files.write_csv(df, f"{out}/{name}")
    report = E.queue_report(metrics, by_regime)
    files.write_report(report, f"{out}/report", spark)
    return report


def train(spark: SparkSession, notes: str, annotations: str, out: str, sources: list[str], names: str, types: str, max_n: int = 5) -> None:
    """Learn a pair of dictionaries and store it. sources: CSV files of section, mention, concept_id in the order they are
    added; names: concept_id, name; types: concept_id, type."""
    texts = files.read_notes(spark, notes)
    gold = spans(spark, annotations).withColumn("seen", F.col("ord"))
    gold = S.with_order(gold.drop("ord"), "start", "end", "seen")
    blacklist = D.common_words(D.corpus_word_count(texts))
    more = [files.read_csv(spark, x, KEYS) for x in sources]
    named, typed = files.read_csv(spark, names, "concept_id bigint, name string"), files.read_csv(spark, types, "concept_id bigint, type string")
    R.train(texts, gold, H.CLINICAL_HEADERS, more, named, blacklist, typed, max_n).save(out)


def predict(spark: SparkSession, notes: str, dictionaries: str, out: str, abbreviations: str | None = None, extensions: str | None = None, max_n: int = 5) -> None:
    """Spans of the notes by a stored pair of dictionaries, as a CSV folder of note_id, start, end, concept_id."""
    texts = files.read_notes(spark, notes)
    read = lambda path, schema: files.read_csv(spark, path, schema) if path else spark.createDataFrame([], schema)
    more = read(extensions, "general_id bigint, specific_id bigint, additional_word string, ord int")
    found = R.predict(texts, H.CLINICAL_HEADERS, R.Dictionaries.load(spark, dictionaries), read(abbreviations, KEYS), more, max_n)
    files.write_csv(S.submission_view(found), out)


def holdout(spark: SparkSession, notes: str, gold: str, dictionary: str, linker: str, static: str, out: str) -> str:
    """Both pairs of the comparison study: the dictionary against the linker, and against what the linker finds beyond the
    static vocabulary. gold, dictionary, linker: span files of the held-out notes; static: term, concept_id.

    Writes, for each pair, the alignments with regime and queue flag, the regime table, the metrics and the review queue's,
    and a Markdown report of both; returns the report.
    """
    texts = files.read_notes(spark, notes)
    held = [cut_lineage(S.with_order(S.submission_view(spans(spark, p)), "start", "end", "concept_id")) for p in (gold, dictionary, linker)]
    vocabulary = files.read_csv(spark, static, "term string, concept_id bigint")
    residual = S.with_order(S.neural_residual(held[2], texts, vocabulary), "start", "end", "concept_id")
    report = []
    for name, title, second in (("a", "Dictionary and linker", held[2]), ("b", "Dictionary and residual", cut_lineage(residual))):
        metrics, aligned, table = E.compare(held[0], held[1], second)
        rows = spark.createDataFrame(list(metrics.items()), "metric string, value double")
        for part, df in (("aligned", E.add_queue_flag(aligned)), ("regimes", table), ("metrics", rows), ("queue", E.queue_metrics(aligned))):
            files.write_csv(df, f"{out}/{name}/{part}")
        report.append(E.study_report(title, metrics, table))
    files.write_report("\n".join(report), f"{out}/report", spark)
    return "\n".join(report)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom")
    commands = parser.add_subparsers(dest="command", required=True)
    options = {
        "score": (("gold", "pred"), ()),
        "review-queue": (("aligned", "out"), ()),
        "train": (("notes", "annotations", "out", "names", "types"), ()),
        "predict": (("notes", "dictionaries", "out"), ("abbreviations", "extensions")),
        "holdout": (("notes", "gold", "dictionary", "linker", "static", "out"), ()),
    }
    for name, (needed, optional) in options.items():
        command = commands.add_parser(name)
        for x in (*needed, *optional):
            command.add_argument(f"--{x}", required=x in needed)
        if name == "train":
            command.add_argument("--sources", nargs="*", default=[])
        if name in ("train", "predict"):
            command.add_argument("--max-n", type=int, default=5)
    given = vars(parser.parse_args(arguments))
    run = {"score": score, "review-queue": review_queue, "train": train, "predict": predict, "holdout": holdout}[given.pop("command")]
    result = run(SparkSession.builder.appName("spanloom").getOrCreate(), **given)
    if isinstance(result, dict):
        print("\n".join(f"{k}: {v:.4f}" for k, v in result.items()))
    elif result:
        print(result)


if __name__ == "__main__":
    main()
