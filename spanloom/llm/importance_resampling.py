"""Target-distribution importance resampling: documents are drawn by how much more the target's words than the corpus' they use.

Words and runs of words are hashed into buckets. The counts of all buckets, in the corpus and in the target, give each bucket a
gain; a document's weight is the sum of its features' gains, looked up in one array. Noise from a hash of the id turns weights
into scores of which the highest are a draw without replacement (Gumbel). The highest are found exactly and without sorting
all rows: a histogram of the integer scores, summed from the top, gives each score the ranks above it and the score at which
the draw ends; only rows from there on are numbered, by id within their score.

The only thing that comes to the driver is the two tables of counts, `buckets` numbers each. Texts are read twice, by Arrow
kernels that hold one slice of rows at a time; scores are written once (checkpoint) and read by histogram and draw.

Null and empty texts have no features: weight 0, their score is the noise alone, and they are never drawn while a least number of
words is asked for. A null id is hashed as an empty one. Very long texts are taken whole. Ties of scores go to the smaller id, then to
fewer features; repeated rows are rows of their own with the same score. Empty tables: no rows, or counts of zero. Other
columns are not read and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.shared import cut_lineage, running_sum
from .common import bound_batches, map_texts, slices, with_release
from .crc_sql import crc32_sql

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
#: Lower-case form of each byte, and 0 where it parts words: ASCII that is neither letter nor digit.
_LOWER = np.array([0 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one behind the other, and the number of words of each text."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    low = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    inside = low != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(low)]
    starts[first] = inside[first]  # a word ends with its text
    kept = np.cumsum(inside, dtype=np.int64)
    at = np.flatnonzero(starts)
    offsets = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[inside].tobytes())])
    return words, np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def features_of(texts: list[bytes], runs: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text that each belongs to, and the number of words of each text."""
    words, n_words = words_of(texts)
    owner, last = np.repeat(np.arange(len(texts)), n_words), np.repeat(np.cumsum(n_words), n_words)
    found, owners = [], []
    for n in range(runs[0], runs[1] + 1):
        at = np.flatnonzero(np.arange(len(words)) + n <= last)
        parts = [words.take(pa.array(at + i)) for i in range(n)]
        grams = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        coded = grams.dictionary_encode()
        crc = np.array([zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()], np.int64)
        found.append(crc[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners), n_words


def bucket_counts(df: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in with_release(batches):
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                total += np.bincount(features_of(texts, runs, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    bound_batches(df.sparkSession)
    counted = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus'."""
    of = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + of) / ((corpus + 1.0) * (target.sum() + of))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(df: DataFrame, gain: np.ndarray, runs: tuple[int, int] = (1, 1), seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)

    def weigh(texts: list[bytes]) -> list:
        found, owner, n_words = features_of(texts, runs, buckets)
        weight = np.zeros(len(texts), np.int64)
        np.add.at(weight, owner, gain[found])
        return [pa.array(n_words.astype(np.int64)), pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int64)), pa.array(weight)]

    weighed = map_texts(df, weigh, "n_words bigint, n_features bigint, weight bigint", id_col, text_col, as_bytes=True)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(rows: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the highest scores of the rows with enough words are ranked, others have null.

    rows: what scored() gives; they are written once."""
    rows = cut_lineage(rows)
    rows = rows.withColumn("fit", F.coalesce(F.col("n_words") >= least_words, F.lit(False)))
    histogram = rows.where("fit").groupBy((-F.col("score")).alias("falling")).agg(F.count("*").alias("n"))
    summed = running_sum(histogram, ["falling"], F.col("n"), "upto")
    places = F.floor(F.sum("n") * share_percent / 100).cast("bigint")
    n_drawn = rows.where("fit").agg(F.count("*").alias("n")).select(F.coalesce(places, F.lit(0))).first()[0]
    surviving = summed.select((-F.col("falling")).alias("score"), (F.col("upto") - F.col("n")).alias("above")).where(F.col("above") < n_drawn)
    cutoff = surviving.agg(F.min("score")).first()[0]
    plain = ("doc_id", "n_features", "weight", "score")
    if cutoff is None:
        return rows.select(*plain, F.lit(None).cast("bigint").alias("rank"))
    high = F.col("fit") & (F.col("score") >= cutoff)
    number = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = rows.where(high).join(surviving, "score").withColumn("rank", (F.col("above") + number).cast("bigint"))
    ranked = ranked.select(*plain, F.when(F.col("rank") <= n_drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~high).select(*plain, F.lit(None).cast("bigint").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rank the documents drawn to resemble `target`; both have a column text, documents doc_id as well."""
    gain = gains(bucket_counts(documents, runs, buckets), bucket_counts(target, runs, buckets))
    return draw(scored(documents, gain, runs, seed), share_percent, least_words)


def resample_sql() -> str:
    """The draw of single words with the parameters above."""
    parted = r"string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, list_filter({parted}, lambda w: w <> '') ws FROM documents),
dw AS (SELECT r, unnest(ws) w FROM d), bw AS (SELECT unnest(list_filter({parted}, lambda w: w <> '')) w FROM benchmark),
u AS (SELECT w, {crc32_sql("w")} % {BUCKETS} k FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT k, count(*) s FROM dw JOIN u USING (w) GROUP BY 1), t AS (SELECT k, count(*) t FROM bw JOIN u USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE ns, (SELECT count(*) FROM bw)::DOUBLE nt),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ns + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (nt + {BUCKETS}))))::BIGINT g FROM s FULL JOIN t USING (k), n),
x AS (SELECT r, count(*) n, sum(g)::BIGINT weight FROM dw JOIN u USING (w) JOIN g USING (k) GROUP BY 1),
h AS (SELECT d.r, doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT h FROM d LEFT JOIN x USING (r)),
c AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) k, count(*) OVER () n FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {SHARE_PERCENT} * n // 100 THEN k END AS rank FROM c LEFT JOIN o USING (r)"""
