"""What the operators of this subpackage share: reading a table, running a kernel over texts, batch bounds."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel gets at once, and rows of an Arrow batch. They bound a Python worker's memory.
KERNEL_BYTES = 8 << 20
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet tables, by whatever file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for texts are long and workers have little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_path(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local master, where there is one machine, may go without
    the setting; a cluster that doesn't name a folder is an error, for executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_path(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote, on whatever file system Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers has its file `name`."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def slices(batch: pa.RecordBatch, column: str, limit: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes; a longer text stands alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind the last one, what a task freed goes back to the system, for Spark keeps workers for later tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def carried(names: tuple[str, ...], taken: tuple[str, ...]) -> dict[str, str]:
    """Columns that an operator hands on and the names they get: one that a result has too ends in `_carried`."""
    return {c: f"{c}_carried" if c in taken else c for c in names if c not in ("doc_id", "text")}


def map_texts(
    df: DataFrame,
    kernel: Callable[[list], list],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_bytes: bool = False,
    carry: tuple[str, ...] = (),
    limit: int = KERNEL_BYTES,
) -> DataFrame:
    """One row per row of df: its id, what `kernel` makes of its text, and the columns of `carry` as they are.

    kernel: list of texts (str, or UTF-8 bytes with as_bytes; null is given as empty) -> list of columns in the order of
    `schema`, which names the columns behind doc_id. Only the columns named are read, so others may have any name; a
    carried column whose name is in `schema` is named as carried() says. limit: bytes of text that the kernel gets at
    once, about; a longer text is given alone.
    """
    bound_batches(df.sparkSession)
    kind = pa.large_binary() if as_bytes else pa.large_string()
    empty = b"" if as_bytes else ""
    out = spark_schema(f"doc_id bigint, {schema}")
    more = [F.col(f"`{c}`").alias(name) for c, name in carried(carry, tuple(out.names)).items()]
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    chosen = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text, *more)
    given = chosen.schema.fields[1 if "text" in carry else 2 :]
    out = type(out)(out.fields + given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for whole in with_release(batches):
            for batch in slices(whole, "text", limit):
                texts = [empty if t is None else t for t in batch.column("text").cast(kind).to_pylist()]
                columns = [*kernel(texts), *batch.columns[len(batch.columns) - len(given) :]]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=arrow)

    return chosen.mapInArrow(run, out)


def spark_schema(ddl: str):
    """A StructType of a DDL string, without a session."""
    from pyspark.sql import types as T

    kinds = {"bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    kinds |= {"double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    kinds |= {f"array<{k}>": T.ArrayType(kinds[k]) for k in ("int", "long", "string")}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])
