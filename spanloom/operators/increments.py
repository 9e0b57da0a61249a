"""Counts of dictionary keys kept per training part, so that new notes move majorities without learning the old ones again.

A part's counts lie in a folder of their own. Putting a part again replaces it, dropping one forgets it, and compacting sums
parts up to one; none of these reads a note. A write counts from the moment it has finished, so a job that dies changes
nothing. Counts of any parts add up to what learning their annotations at once gives, ties included, if `seen` orders the
annotations across parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionary as D


class CountStore:
    """Counts (keys, concept_id, n, first_seen) by part below a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("section", "mention")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        kinds = ", ".join(f"`{k}` string" for k in keys)
        self.schema = f"{kinds}, concept_id bigint, n bigint, first_seen bigint"

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._place("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _runs(self, part: str | None = None) -> dict[str, list[tuple[int, str]]]:
        """Finished writes of each part, by time."""
        files, found = self._files(), {}
        if not files.exists(self._place("")):
            return found
        for folder in files.listStatus(self._place("")):
            name, _, _ = folder.getPath().getName().partition("@")
            done = self._place(f"{folder.getPath().getName()}/_SUCCESS")
            if part in (None, name) and files.exists(done):
                found.setdefault(name, []).append((files.getFileStatus(done).getModificationTime(), folder.getPath().getName()))
        return {name: sorted(runs) for name, runs in found.items()}

    def parts(self) -> list[str]:
        return sorted(self._runs())

    def put(self, part: str, counts: DataFrame) -> None:
        """Store a part's counts in place of what it had."""
        if not part or set(part) & set("/@="):
            raise ValueError(f"not a name for a part: {part!r}")
        old = [run for _, run in self._runs(part).get(part, [])]
        fields = [*self.keys, "concept_id", "n", "first_seen"]
        counts.select(*(F.col(c).cast("string" if c in self.keys else "bigint").alias(c) for c in fields)).write.parquet(f"{self.path}/{part}@{uuid.uuid4().hex}")
        for run in old:
            self._files().delete(self._place(run), True)

    def drop(self, part: str) -> None:
        for _, run in self._runs(part).get(part, []):
            self._files().delete(self._place(run), True)

    def counts(self, parts: list[str] | None = None) -> DataFrame:
        """The counts of all parts, or of those named, added up; a part without counts adds nothing."""
        runs = [f"{self.path}/{r[-1][1]}" for name, r in sorted(self._runs().items()) if parts is None or name in parts]
        stored = self.spark.read.schema(self.schema).parquet(*runs) if runs else self.spark.createDataFrame([], self.schema)
        return stored.groupBy(*self.keys, "concept_id").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))

    def compact(self, into: str) -> None:
        """One part in place of all: written first, then the others go."""
        others = [p for p in self.parts() if p != into]
        self.put(into, self.counts())
        for p in others:
            self.drop(p)

    def majorities(self, parts: list[str] | None = None) -> DataFrame:
        """keys, concept_id, n, total: the majority of each key over the parts."""
        return D.majority(self.counts(parts), list(self.keys))

    def section_dictionary(self, min_count: int = 1, parts: list[str] | None = None) -> DataFrame:
        """section, mention, concept_id, as dictionary.section_dictionary() makes it of all annotations at once."""
        return D.kept_majorities(self.majorities(parts), min_count)
