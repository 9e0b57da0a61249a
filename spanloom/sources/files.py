"""Readers and writers of the file formats of terminologies, notes, spans, lexicons and graphs; all with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CONCEPT = "id bigint, effectiveTime string, active int, moduleId bigint, definitionStatusId bigint"
DESCRIPTION = "id bigint, effectiveTime string, active int, moduleId bigint, conceptId bigint, languageCode string, typeId bigint, term string, caseSignificanceId bigint"
RELATIONSHIP = "id bigint, effectiveTime string, active int, moduleId bigint, sourceId bigint, destinationId bigint, relationshipGroup int, typeId bigint, characteristicTypeId bigint, modifierId bigint"
OMOP_CONCEPT = "concept_id int, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string, valid_start_date string, valid_end_date string, invalid_reason string"
OMOP_RELATIONSHIP = "concept_id_1 int, concept_id_2 int, relationship_id string, valid_start_date string, valid_end_date string, invalid_reason string"

#: What CSV needs to give every text back: blanks at a cell's ends stay, NUL is no escape, a null is an empty cell and an empty text a
#: quoted one. On reading an empty cell takes the null's name, so that a quoted one is not taken for it. Both use noncharacters.
CSV_OPTIONS = {"quote": '"', "escape": '"', "charToEscapeQuoteEscaping": "\uffff", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_NULL = "\ufffe\uffff"


def read_rf2(spark: SparkSession, path: str, schema: str, quotes: bool = False, active_only: bool = True) -> DataFrame:
    """A tab-separated release file; quotes are ordinary characters unless asked for. Cells are trimmed."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"' if quotes else "", escape='"' if quotes else "", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.where("active = 1") if active_only else df


def read_omop(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated vocabulary file; only the columns asked for are parsed."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape="")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV whose cells may hold line feeds; .gz is unpacked by Spark (one task a file)."""
    return spark.read.options(**CSV_OPTIONS).csv(path, schema=schema, multiLine=True, nullValue=CSV_NULL)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "note_id string, text string")


def read_spans(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    return read_csv(spark, path, f"note_id string, start int, end int, concept_id bigint{', ' + extra if extra else ''}")


def read_texts_gz(spark: SparkSession, path: str, schema: str, partitions: int) -> DataFrame:
    """The text column of a packed file, dealt to partitions, as such a file can't be split."""
    return read_csv(spark, path, schema).select("text").repartition(partitions)


def read_tables(spark: SparkSession, root: str, parts: list[tuple[str, str, str]]) -> list[DataFrame]:
    """root/dataset/table_split.parquet for (dataset, table, split), each with dataset and split as columns."""
    return [spark.read.parquet(f"{root}/{d}/{t}_{s}.parquet").withColumns({"dataset": F.lit(d), "split": F.lit(s)}) for d, t, s in parts]


def read_synonyms_json(spark: SparkSession, path: str) -> DataFrame:
    """sctid, synonyms from lines of {"sctid": ..., "synonyms": [...]}."""
    return read_jsonl(spark, path, "sctid bigint, synonyms array<string>")


def write_synonyms_json(df: DataFrame, path: str) -> None:
    df.select("sctid", "synonyms").write.mode("overwrite").json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """label, embedding without rows that have NaN or infinity."""
    from ..operators.vectors import drop_invalid

    return drop_invalid(spark.read.schema("label bigint, embedding array<float>").parquet(path))


def save_lexicon(df: DataFrame, path: str, buckets: str | None = None) -> None:
    """A lexicon as Parquet, sorted by mention within files so that row groups prune lookups."""
    df.sortWithinPartitions(buckets or df.columns[0]).write.mode("overwrite").parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path, compression=compression)


def write_csv_oneline(df: DataFrame, path: str) -> None:
    """CSV in which each row is one line: line ends become a backslash and n, tabs a space, in every string column."""
    from ..operators.corpus import flat_export

    write_csv(flat_export(df), path)


def read_csv_oneline(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """The inverse: line feeds restored in the columns; rows are split by line, so big files are read in parallel."""
    df = spark.read.options(**CSV_OPTIONS).csv(path, schema=schema)
    return df.withColumns({c: T.restore_lines(c) for c in columns})


def write_jsonl(df: DataFrame, path: str) -> None:
    """Lines of JSON in UTF-8 that keep keys of nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with texts of any length; by default a line with one above 20 million characters comes as nulls."""
    return spark.read.option("maxStringLen", 2**31 - 1).json(path, schema=schema)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder for each value of the columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is stored at path, built and stored first where it isn't (or by force). Any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _place(spark: SparkSession, path: str):
    """A path and its file system, whatever Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists; none of them is an error."""
    for path in paths:
        place, files = _place(spark, path)
        if files.exists(place):
            return path
    raise FileNotFoundError(f"none of {paths}")


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def rewrite_oneline(spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
    """CSV folders below `folder`, by name with their schemas, rewritten with each row on one line. The new files are written
    beside the old ones and take their name when they are whole."""
    for name, schema in schemas.items():
        write_csv_oneline(read_csv(spark, f"{folder}/{name}", schema), f"{folder}/{name}.new")
        remove(spark, f"{folder}/{name}")
        place, files = _place(spark, f"{folder}/{name}.new")
        files.rename(place, _place(spark, f"{folder}/{name}")[0])


def checkpoints(spark: SparkSession, root: str, kind: str | None = None) -> list[str]:
    """Folders of stored models below root, by name: those with `kind` in their name, all where no name has it; without a
    kind those of no other kind (mixup). None is an error."""
    place, files = _place(spark, root)
    found = sorted(x.getPath().toString() for x in files.listStatus(place) if x.isDirectory())
    has = lambda path, word: word in path.rsplit("/", 1)[-1].lower()
    chosen = [p for p in found if has(p, kind.lower())] or found if kind else [p for p in found if not has(p, "mixup")]
    if not chosen:
        raise FileNotFoundError(f"no model of kind {kind or 'baseline'} below {root}")
    return chosen


def write_report(text: str, path: str, spark: SparkSession) -> None:
    """A Markdown report as one text file in a folder."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class Paths:
    """Folders of an installation below one root, from the argument or the variable SPANLOOM_HOME."""

    def __init__(self, root: str | None = None):
        import os

        self.root = (root or os.environ.get("SPANLOOM_HOME", ".")).rstrip("/")

    def raw(self, name: str) -> str:
        return f"{self.root}/raw/{name}"

    def interim(self, name: str) -> str:
        return f"{self.root}/interim/{name}"

    def results(self, name: str) -> str:
        return f"{self.root}/results/{name}"
