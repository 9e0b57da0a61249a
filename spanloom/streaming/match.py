"""Dictionary matching over a stream of notes, and windowed counts of its hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import spans as S


def match_stream(notes: DataFrame, dictionary: DataFrame, max_n: int, path: str, checkpoint: str, available_now: bool = True):
    """Start a query that matches each micro-batch of notes and appends spans as Parquet; matching has no state across notes.

    The batch id names the output folder and is overwritten on replay, so each batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = S.submission_view(D.predict_with_dictionary(batch, dictionary, max_n))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def hits_per_window(hits: DataFrame, time: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """concept_id, window, n of a stream of hits, with a watermark for late ones."""
    return hits.withWatermark(time, late).groupBy(F.window(time, size), "concept_id").agg(F.count("*").alias("n"))
