"""Cutting lineage in the shared folder, and running sums over all rows without a single task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_path(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local master, where there is one machine, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_path(df.sparkSession))
    return df.checkpoint()


def running_sum(df: DataFrame, order: list[str], value, name: str) -> DataFrame:
    """Add the sum of `value` over all rows up to this one in the order given, which must tell rows apart.

    Rows are range-partitioned and summed within partitions; the partitions' totals, one row each, give the offsets. The
    partitions are written before they are read twice, so that both readings see the same ones.
    """
    parted = cut_lineage(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = parted.groupBy("__p").agg(F.sum("__v").alias("__t"))
    before = F.coalesce(F.sum("__t").over(W.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("__v").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parted.withColumn("__s", own).join(totals.select("__p", before.alias("__o")), "__p").withColumn(name, F.col("__o") + F.col("__s")).drop("__p", "__v", "__s", "__o")
