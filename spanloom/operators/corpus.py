"""Corpora: schema reconciliation, ids, manifests, folds, flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .shared import running_sum


def tagged(df: DataFrame, dataset: str, split: str, is_expert: bool, repo: str) -> DataFrame:
    """Constant columns dataset, split, is_expert, hf_repo."""
    return df.withColumns({"dataset": F.lit(dataset), "split": F.lit(split), "is_expert": F.lit(is_expert), "hf_repo": F.lit(repo)})


def present(df: DataFrame, columns: list[str], prefix: str | None = None) -> DataFrame:
    """Of the columns those that exist, in their order, then others that begin with the prefix."""
    more = [c for c in df.columns if prefix and c.startswith(prefix) and c not in columns]
    return df.select(*(c for c in columns if c in df.columns), *more)


def unify_documents(parts: list[DataFrame], text: list[str], name: list[str], label: list[str]) -> DataFrame:
    """One document table from tables with different columns: report, full_text, doc_label are the first non-empty of the
    candidate columns that a table has; constant columns follow."""
    out = None
    for df in parts:
        pick = lambda names: T.first_non_empty(*(F.col(c).cast("string") for c in names if c in df.columns))  # noqa: E731,B023
        one = df.select(*(c for c in ("dataset", "split", "is_expert", "hf_repo") if c in df.columns), pick(name).alias("report"), pick(text).alias("full_text"), pick(label).alias("doc_label"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def unify_spans(parts: list[DataFrame]) -> DataFrame:
    """One span table: note_id from report or note_id, label from label or span_type, attribute columns kept."""
    out = None
    for df in parts:
        pick = lambda names: T.first_non_empty(*(F.col(c).cast("string") for c in names if c in df.columns))  # noqa: E731,B023
        fixed = df.select(*(c for c in ("dataset", "split", "is_expert", "hf_repo") if c in df.columns), pick(["report", "note_id"]).alias("note_id"), F.col("start").cast("int"), F.col("end").cast("int"), pick(["span", "extracted_span"]).alias("span"), pick(["label", "span_type"]).alias("label"), *(c for c in df.columns if c.startswith("attribute_")))
        out = fixed if out is None else out.unionByName(fixed, allowMissingColumns=True)
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, dataset, split, is_expert, n_rows; null groups count."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("dataset", "split", "is_expert").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "dataset", "split", "is_expert", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def dense_ids(df: DataFrame, order: list[str], name: str = "annotation_id", within: list[str] | None = None) -> DataFrame:
    """Numbers from 1 in the order given, restarting in each group of `within`; without groups no task sees all rows."""
    if within:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*order)))
    return running_sum(df, order, F.lit(1).cast("bigint"), name)


def in_order_of(df: DataFrame, notes: DataFrame, key: str = "note_id", order: str = "ord", then: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Sorted by the place of their note in another table, then by offsets."""
    place = notes.select(key, F.col(order).alias("__place"))
    return df.join(place, key).orderBy("__place", *then).drop("__place")


def notes_jsonl(documents: DataFrame) -> DataFrame:
    """note_id, text, doc_label with nulls as empty."""
    return documents.select(F.col("report").alias("note_id"), F.coalesce("full_text", F.lit("")).alias("text"), F.coalesce("doc_label", F.lit("")).alias("doc_label"))


def french_view(df: DataFrame) -> DataFrame:
    """note_id, start, end, label (concept_id where there is none), text of prediction files."""
    label = [F.col(c).cast("string") for c in ("label", "concept_id") if c in df.columns]
    text = [F.col(c) for c in ("span", "extracted_span") if c in df.columns]
    return df.select("note_id", F.col("start").cast("int"), F.col("end").cast("int"), F.coalesce(*label).alias("label"), (F.coalesce(*text) if text else F.lit(None).cast("string")).alias("text"))


def flat_export(df: DataFrame) -> DataFrame:
    """String columns on one line each."""
    return df.withColumns({c: T.one_line(c) for c, k in df.dtypes if k == "string"})


def by_split(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """The splits' rows with a `split` column, sorted by split and order."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("split", *order)


# --- splits ----------------------------------------------------------------------------------------------------------
def folds(df: DataFrame, key: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Add `fold` from 0 by the first 32 bits of md5("key|seed"): the same everywhere, no shuffle. Sizes are equal up to chance."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("fold", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add `__r`: the place of a row by a seeded hash of its key, from 1."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    return dense_ids(hashed, ["__h", key], "__r").drop("__h")


def exact_folds(df: DataFrame, key: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """Add `fold` with just these sizes, by the rank of a hash; another number of rows raises."""
    n = df.count()
    if n != sum(sizes):
        raise ValueError(f"{n} rows for sizes {sizes}")
    fold = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        fold = F.when(F.col("__r") <= sum(sizes[: i + 1]), i).otherwise(fold)
    return _ranked(df, key, seed).withColumn("fold", fold).drop("__r")


def cross_validation(df: DataFrame, key: str, k: int = 5, seed: int = 123456) -> DataFrame:
    """Add `fold` of n // k rows each by the rank of a hash; the last fold takes what is left."""
    size = max(1, df.count() // k)
    return _ranked(df, key, seed).withColumn("fold", F.least(F.floor((F.col("__r") - 1) / size), F.lit(k - 1)).cast("int")).drop("__r")


def follow(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """The annotations of the given notes."""
    return annotations.join(notes.select("note_id"), "note_id", "left_semi")
