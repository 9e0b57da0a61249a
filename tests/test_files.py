"""Files give back every text as it was."""

from spanloom.functions import text as T
from spanloom.sources import files

ODD = ["", " ", "\n", " a", "a\t", "\ra\r\n", "\x00", "\x00a,\"", "a,\x00", '"', '"a\\"', "\\", "\\n", " a", "﻿", " a", "a\x1f", None, '""', "null", "\x1a", "a\n\nb", ' "q" ', "c" * 21_000_000]
SCHEMA = "doc_id bigint, text string"


def same(got, want):
    assert got.count() == want.count() == want.join(got.withColumnRenamed("text", "found"), "doc_id").where("text <=> found").count()


def test_odd_texts_come_back(spark, tmp_path):
    """Blanks at a text's ends, empty texts beside nulls, NUL in quoted cells, texts above 20 million characters."""
    docs = spark.createDataFrame(list(enumerate(ODD)), SCHEMA).localCheckpoint()
    files.write_csv(docs, f"{tmp_path}/folder/docs")
    same(files.read_csv(spark, f"{tmp_path}/folder/docs", SCHEMA), docs)
    files.write_csv(docs, f"{tmp_path}/gz", compression="gzip")
    same(files.read_csv(spark, f"{tmp_path}/gz", SCHEMA), docs)
    files.write_jsonl(docs, f"{tmp_path}/jsonl")
    same(files.read_jsonl(spark, f"{tmp_path}/jsonl", SCHEMA), docs)
    files.rewrite_oneline(spark, f"{tmp_path}/folder", {"docs": SCHEMA})
    same(files.read_csv(spark, f"{tmp_path}/folder/docs", SCHEMA), docs.withColumn("text", T.one_line("text")))
