"""Benchmark decontamination with an FM-index per shard of documents.

A test phrase is a window of WINDOW consecutive words of a benchmark item, or all its words where it has fewer. A shard is
a run of whole documents of about 8 MB. Of its words only maximal runs of words that occur in phrases, as long as the
shortest phrase or longer, can hold an occurrence; these runs, with a mark between, are indexed. All phrases are searched
backwards at once by wavelet ranks, their occurrences are located by sampled suffix positions, and the words they cover
are merged to removal spans.

The phrases go to the workers in blocks of items of at most BLOCK_BYTES of text; every shard is tested against each block.
At most BROADCAST_BLOCKS blocks are broadcast at a time. A benchmark beyond that is written once by blocks to the shared
folder and taken in rounds: a round's hits are written with the documents, its broadcasts are destroyed, and hits of all
rounds are merged per row, without a shuffle. So the benchmark may have any size; a round costs one pass over the documents.
One item longer than BLOCK_BYTES is a block of its own size. Null or empty text has no words, and an item without words has no phrase. Repeated
documents get a result each; items that repeat an item_id count once. An item without an item_id removes what it covers and
is listed as an empty string. Very long texts are read whole, alone in their shard. Spans that touch are merged, so
there are no ties. An empty table gives an empty result; an
empty benchmark leaves all documents clean. Other columns are not read and may have any name; see common.carried() for
those handed on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import carried, map_texts, remove_folder, shared_path, spark_schema
from .fm_index import FmIndex

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Blocks that are broadcast at a time; a block's windows take some 20 times its text.
BROADCAST_BLOCKS = 4
#: Bytes of a word: digits, letters a to z, all of 80 and above; A to Z become small; others become spaces.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
MARK, FIRST = 1, 2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """words_of() a text, a piece at a time."""
    low, at = text.translate(WORD_BYTES), 0
    while at < len(low):
        blank = low.find(b" ", at + PIECE)
        end = blank if blank >= 0 else len(low)
        yield low[at:end].split()
        at = end


class Phrases:
    """The windows of a block of items as rows of word numbers, and the items each comes from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for name, text in items:
            words = [self.numbers.setdefault(w, FIRST + len(self.numbers)) for w in words_of(text)]
            item = names.setdefault(name, len(names))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.names = list(names)
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.rows[i, window - len(w) :] = w
        self.shortest = int(self.sizes.min()) if len(windows) else 0
        each = list(windows.values())
        self.bound = np.append(0, np.cumsum([len(x) for x in each], dtype=np.int64))
        self.items = np.array([i for x in each for i in sorted(x)], np.int64)
        self.sigma = FIRST + len(self.numbers)


def occurrences(phrases: Phrases, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word position and phrase of each occurrence in a shard. numbers: of each word, 0 if in no phrase; doc: its document."""
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(numbers):
        return none, none
    known = numbers > 0
    edge = np.append(True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]))
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(numbers)))
    kept = known[start] & (size >= phrases.shortest)
    start, size = start[kept], size[kept]
    if not len(start):
        return none, none
    place = np.cumsum(size + 1) - size - 1  # of each run in the indexed text, a mark behind each
    text = np.full(int((size + 1).sum()), MARK, np.int64)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(place, size) + offset] = numbers[np.repeat(start, size) + offset]
    index = FmIndex(text, phrases.sigma)
    low, high = index.search(phrases.rows)
    n = high - low
    n[n < 0] = 0
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = index.locate(rows)
    run = np.searchsorted(place, at, "right") - 1
    return start[run] + at - place[run], phrase


def hit_runs(text: bytes, hit: np.ndarray) -> np.ndarray:
    """Rows (first word, word behind the last one, first code point, code point behind the last one) of runs of hit words."""
    low = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    places = np.flatnonzero(low ^ np.append(False, low[:-1]))
    starts, ends = places[::2], np.append(places[1::2], [len(low)] * (len(places) % 2)).astype(np.int64)
    runs = np.flatnonzero(hit ^ np.append(False, hit[:-1]))
    first, behind = runs[::2], np.append(runs[1::2], [len(hit)] * (len(runs) % 2)).astype(np.int64)
    bounds = np.stack([starts[first], ends[behind - 1]], 1).ravel().tolist()
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    chars = np.cumsum([np.count_nonzero(lead[x:y]) for x, y in zip([0, *bounds], bounds, strict=False)]).reshape(-1, 2)
    return np.concatenate([np.stack([first, behind], 1), chars], 1).astype(np.int64)


def spans_of(runs: np.ndarray) -> str:
    return ",".join(f"{s}:{e}" for s, e in runs[:, 2:].tolist())


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs of several rounds as one: those that share words or follow each other directly are joined."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    words, chars = np.maximum.accumulate(runs[:, 1]), np.maximum.accumulate(runs[:, 3])
    first = np.flatnonzero(np.append(True, runs[1:, 0] > words[:-1]))
    last = np.append(first[1:], len(runs)) - 1
    return np.stack([runs[first, 0], words[last], runs[first, 2], chars[last]], 1)


def find_hits(texts: list[bytes], blocks: list) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Of the texts of a shard: words, which of them are hit, and the items found. Words are held as numbers alone."""
    names: list[set[str]] = [set() for _ in texts]
    counts = cover = doc = None
    for block in blocks:
        phrases: Phrases = block.value
        get = phrases.numbers.get
        each = [np.fromiter((get(w, 0) for ws in word_pieces(t) for w in ws), np.int32) for t in texts]
        if cover is None:
            counts = np.array([len(x) for x in each], np.int64)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
            cover = np.zeros(len(doc) + 1, np.int32)
        at, phrase = occurrences(phrases, np.concatenate(each), doc)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.sizes[phrase], -1)
        pair = np.unique(np.stack([doc[at], phrase], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        for d, p in pair.tolist():
            names[d].update(phrases.names[i] for i in phrases.items[phrases.bound[p] : phrases.bound[p + 1]].tolist())
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # one block in memory at a time
    base = np.append(0, np.cumsum(counts))
    hit = np.cumsum(cover)[:-1] > 0
    return counts, [hit[base[i] : base[i + 1]] for i in range(len(texts))], names


def scan_shard(texts: list[bytes], blocks: list) -> list:
    """Columns n_words, n_hit, items (array of strings, sorted), spans (start:end, comma-joined) of the texts of a shard."""
    counts, hits, names = find_hits(texts, blocks)
    spans = [spans_of(hit_runs(t, h)) if h.any() else "" for t, h in zip(texts, hits, strict=True)]
    return [counts.tolist(), [int(h.sum()) for h in hits], [sorted(x) for x in names], spans]


def scan_round(texts: list[bytes], blocks: list) -> list:
    """Columns n_words, runs (those of hit_runs() in a row), items of the texts of a shard."""
    counts, hits, names = find_hits(texts, blocks)
    runs = [hit_runs(t, h).ravel().tolist() if h.any() else [] for t, h in zip(texts, hits, strict=True)]
    return [counts.tolist(), runs, [sorted(x) for x in names]]


class Benchmark:
    """The items of a benchmark as blocks of phrases, broadcast a few at a time."""

    def __init__(self, df: DataFrame, window: int, id_col: str, text_col: str):
        self.spark, self.window = df.sparkSession, window
        name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name")
        rows = df.select(name, F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
        self.n = max(1, -(-int(total) // BLOCK_BYTES))
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(self.n)))
        if self.n > BROADCAST_BLOCKS:  # each block is then read by itself
            self.folder = f"{shared_path(self.spark)}/benchmark-{uuid.uuid4().hex}"
            self.rows.repartition("block").write.partitionBy("block").parquet(f"{self.folder}/items")
            self.rows = self.spark.read.schema("name string, text string, block long").parquet(f"{self.folder}/items")

    def broadcast(self, i: int):
        items = self.rows.where(F.col("block") == i).select("name", "text").orderBy("name", "text")
        return self.spark.sparkContext.broadcast(Phrases([(r.name, r.text.encode()) for r in items.toLocalIterator()], self.window))

    def rounds(self) -> Iterator[list]:
        for i in range(0, self.n, BROADCAST_BLOCKS):
            yield [self.broadcast(j) for j in range(i, min(self.n, i + BROADCAST_BLOCKS))]


@F.pandas_udf(spark_schema("n_hit long, spans string"))
def _sum_up(runs: pd.Series) -> pd.DataFrame:
    joined = [merged(np.asarray(r, np.int64).reshape(-1, 4)) for r in runs]
    return pd.DataFrame({"n_hit": [int((r[:, 1] - r[:, 0]).sum()) for r in joined], "spans": [spans_of(r) for r in joined]})


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without_spans(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def _in_rounds(df: DataFrame, bench: Benchmark, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """decontaminate() for a benchmark that isn't broadcast as a whole."""
    spark = df.sparkSession
    names = carried(carry, ("doc_id", "n_words", "n_hit", "items", "spans"))
    kept = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]
    found = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *kept)
    found = found.withColumns({"__runs": F.array().cast("array<long>"), "__items": F.array().cast("array<string>")})
    rest = [f"__c{i}" for i in range(len(names))]
    for i, blocks in enumerate(bench.rounds()):
        kernel = lambda texts, blocks=blocks: scan_round(texts, blocks)
        one = map_texts(found, kernel, "n_words long, runs array<long>, items array<string>", as_bytes=True, carry=("text", "__runs", "__items", *rest))
        both = {"__runs": F.concat("__runs", "runs"), "__items": F.array_union("__items", "items")}
        one.withColumns(both).drop("runs", "items").write.parquet(f"{bench.folder}/round-{i}")
        found = spark.read.parquet(f"{bench.folder}/round-{i}")
        for block in blocks:
            block.destroy()
        if i:
            remove_folder(spark, f"{bench.folder}/round-{i - 1}")
    remove_folder(spark, f"{bench.folder}/items")
    found = found.withColumn("__sum", _sum_up("__runs"))
    out = ["doc_id", "n_words", F.col("__sum.n_hit").alias("n_hit"), F.array_sort("__items").alias("items"), F.col("__sum.spans").alias("spans")]
    texts = ["text"] if "text" in carry else []
    return found.select(*out, *texts, *(F.col(c).alias(name) for c, name in zip(rest, names.values(), strict=True)))


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (item_ids as sorted strings), spans (code points to remove) of each row of df, and the
    columns of `carry`."""
    bench = Benchmark(benchmark, window, item_col, item_text_col)
    if bench.n > BROADCAST_BLOCKS:
        return _in_rounds(df, bench, id_col, text_col, carry)
    (blocks,) = bench.rounds()
    return map_texts(df, lambda texts: scan_shard(texts, blocks), "n_words long, n_hit long, items array<string>, spans string", id_col, text_col, as_bytes=True, carry=carry)


def without_contamination(df: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """doc_id, clean (the text without its removal spans; null stays null) and the columns of `carry`, of each row of df."""
    bench = Benchmark(benchmark, window, "item_id", "text")
    names = carried(carry, ("doc_id", "clean"))
    if bench.n > BROADCAST_BLOCKS:
        given = [F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(names)]
        found = _in_rounds(df.select("doc_id", "text", *given), bench, "doc_id", "text", ("text", *(f"__d{i}" for i in range(len(names)))))
        return found.select("doc_id", _cut("text", "spans").alias("clean"), *(F.col(f"__d{i}").alias(name) for i, name in enumerate(names.values())))
    (blocks,) = bench.rounds()
    kernel = lambda texts: [[without_spans(t.decode(), s) for t, s in zip(texts, scan_shard(texts, blocks)[3], strict=True)]]
    found = map_texts(df, kernel, "clean string", as_bytes=True, carry=("text", *carry))
    clean = F.when(F.col("text").isNotNull(), F.col("clean")).alias("clean")
    return found.select("doc_id", clean, *(f"`{c}`" for c in names.values()))


def without_spans(text: str, spans: str) -> str:
    """The text without its removal spans; what stands on both sides is kept as it is."""
    out, last = [], 0
    for s, e in (map(int, x.split(":")) for x in spans.split(",") if x):
        out.append(text[last:s])
        last = e
    return "".join([*out, text[last:]])
