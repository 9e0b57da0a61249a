"""Many patterns at once: a trie over the token ids of a lexicon, walked by all token positions of many notes together.

A lexicon is dealt into shards by a hash of its keys; a shard has a bounded number of bytes, is brought to the driver,
built into a trie of sorted arrays and broadcast. Each shard is one narrow pass over the notes: no n-gram becomes a row, no
text is shuffled, and a task holds one shard and one piece of text. Texts are at hand where a hit is found, so spelling,
word boundaries and header lines are decided there, and hits leave as offsets with the columns of their entries.

A lexicon of terms that is learned from notes grows with them, and so would the number of passes. If it has more than one
shard, match_terms() joins n-grams with it by their text: one pass over the notes drops the n-grams that a broadcast map of
the keys' hashes (SLOT_BITS at most) rules out, and the rest meet their entries in a shuffle. match_mentions() does the same
with folded keys; a candidate carries the text around it, as far as the longest outer signs of a mention reach, and whether it is in a
header line, so that the spelling is decided behind the join. longest_terms() spares most of that shuffle where terms are weighed.

Null and empty texts have no hit; null keys and keys without a token match nothing; repeated entries each match. A text of
any length is scanned in one go of linear time. Empty notes or an empty lexicon give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut_lineage
from .spans import chain_bounds, longest_of
from .tokens import PIECE_BYTES, _pieces, _scan, order_in_row

#: Bytes of a shard: what one broadcast and one driver task hold.
SHARD_BYTES = 16 << 20
#: Bits of the largest map of keys, as a power of two (64 MB); with fuller maps more n-grams are shuffled for nothing.
SLOT_BITS = 29
#: Shards' worth of terms that are looked up in the text where terms are weighed.
HEAVY_SHARDS = 4
#: Weights of terms are told apart up to this one.
WEIGHTS = 4096
_SPACE = " \t\n\x0b\f\r"


def fold(gram: Column) -> Column:
    """The key that a mention and its matches share: runs of a-z and 0-9 joined by spaces, without a plural's last s."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(gram), "[^a-z0-9]+", " ")), "s+$", "")


@lru_cache(1 << 16)
def spelling(mention: str) -> re.Pattern:
    """A mention as an expression for a whole match: special characters stand for themselves, white space for any run of it,
    hyphens and slashes also for a space, and a plural's s may follow."""
    parts = {"-": "[- ]", "/": "[/ ]"}
    pieces = re.findall(r"\s+|.", mention, re.ASCII | re.DOTALL)
    return re.compile("".join(r"\s+" if p[0] in _SPACE else parts.get(p) or re.escape(p) for p in pieces) + "s*", re.ASCII)


def spelled(mention: str, surface: str) -> bool:
    """Whether spelling(mention) matches the whole surface; told without an expression, which takes longer to make than to use."""
    if surface.startswith(mention):
        return not surface[len(mention) :].strip("s") or spelling(mention).fullmatch(surface) is not None
    i = j = 0
    while i < len(mention):
        c, x = mention[i], surface[j : j + 1]
        if c in _SPACE:
            while mention[i : i + 1] and mention[i] in _SPACE:
                i += 1
            if mention[i : i + 1] in ("-", "/"):  # both may take the space
                return spelling(mention).fullmatch(surface) is not None
            if not x or x not in _SPACE:
                return False
            while surface[j : j + 1] and surface[j] in _SPACE:
                j += 1
            continue
        if c != x and not (c in "-/" and x == " "):
            return False
        i, j = i + 1, j + 1
    return not surface[j:].strip("s")


class Trie:
    """Keys of tokens parted by single spaces, as sorted arrays: edges (node, token) to nodes, ends (node, last token) to entries."""

    def __init__(self, keys: pa.Array):
        lists = pc.split_pattern(keys.cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, width = np.cumsum(sizes) - sizes, max(1, len(self.words))
        self.width, self.depth = width, int(sizes.max(initial=0))
        node, used, edges, children = np.zeros(len(keys), np.int64), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(self.depth - 1):
            longer = np.flatnonzero(sizes > j + 1)
            step, which = np.unique(node[longer] * width + ids[begin[longer] + j], return_inverse=True)
            node[longer] = used + which
            edges.append(step)
            children.append(used + np.arange(len(step)))
            used += len(step)
        order = np.argsort(np.concatenate(edges), kind="stable")
        self.edges, self.children = np.concatenate(edges)[order], np.concatenate(children)[order]
        last = node * width + ids[begin + sizes - 1] if len(keys) else node
        self.entries = np.argsort(last, kind="stable")
        self.ends, self.first = np.unique(last[self.entries], return_index=True)
        self.first = np.append(self.first, len(last))

    def ids(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words.cast(pa.large_string()), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def find(self, row: np.ndarray, inner: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, last token and entry of each match; inner and last: the ids of tokens within and at a key's end."""
        at, node, found = np.arange(len(row)), np.zeros(len(row), np.int64), []
        for j in range(self.depth):
            here = at + j
            fits = here < len(row)
            fits[fits] = row[here[fits]] == row[at[fits]]
            at, node, here = at[fits], node[fits], here[fits]
            place, hit = self._look(self.ends, node, last[here])
            place, many = place[hit], np.diff(self.first)[place[hit]] if len(self.ends) else place[hit]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(at[hit], many), np.repeat(here[hit], many), self.entries[np.repeat(self.first[place], many) + inside]))
            place, hit = self._look(self.edges, node, inner[here])
            at, node = at[hit], self.children[place[hit]]
        parts = found or [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    def _look(self, table: np.ndarray, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = node * self.width + word
        place = np.minimum(np.searchsorted(table, key), max(0, len(table) - 1))
        return place, (word >= 0) & (table[place] == key) if len(table) else np.zeros(len(key), bool)


def _kept(lexicon: DataFrame) -> tuple[DataFrame, int]:
    """The written lexicon without empty keys (column `__key`), and how many parts of bounded size it needs."""
    lexicon = cut_lineage(lexicon.where(F.col("__key").isNotNull() & (F.col("__key") != "")))
    return lexicon, max(1, -(-(lexicon.agg(F.sum(_entry_bytes(lexicon))).first()[0] or 0) // SHARD_BYTES))


def _entry_bytes(lexicon: DataFrame) -> Column:
    return sum((F.coalesce(F.octet_length(c).cast("bigint"), F.lit(8)) if t == "string" else F.lit(16) for c, t in lexicon.dtypes), F.lit(64))


def _shards(lexicon: DataFrame, many: int) -> Iterator[pa.Table]:
    for i in range(many):
        part = lexicon if many == 1 else lexicon.where(F.pmod(F.xxhash64("__key"), F.lit(many)) == i)
        yield part.toArrow().combine_chunks()


def _slots(coded: np.ndarray, first: np.ndarray, n: int, bits: int, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Both places in a map of 2 ** bits of the n tokens from each of `first` on; coded: a number for each token; last: for each
    as a key's last token, where that differs."""
    mixed = np.full(len(first), n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ (coded if last is None or k < n - 1 else last)[first + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return tuple(mixed * np.uint64(odd) >> np.uint64(64 - bits) for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _ruled_in(first: np.ndarray, slots: tuple[np.ndarray, ...], held: np.ndarray) -> np.ndarray:
    """Those of `first` whose places in the map are all taken."""
    while slots:
        slot = slots[0]
        taken = held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
        first, slots = first[taken], tuple(x[taken] for x in slots[1:])
    return first


def _coded(words: pa.Array) -> np.ndarray:
    encoded = words.dictionary_encode()
    codes = np.fromiter((zlib.crc32(w.encode()) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    return codes[encoded.indices.to_numpy(zero_copy_only=False)]


def _key_map(lexicon: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2 ** bits slots: whether a key of the lexicon may lie there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 6), np.uint64)  # one map a task, so that no key becomes a row
        for batch in batches:
            lists = pc.split_pattern(batch.column(0).cast(pa.large_string()), " ")
            coded = _coded(lists.flatten())
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                for slot in _slots(coded, begin[sizes == n], n, bits):
                    np.bitwise_or.at(own, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        words = own.view(np.int64)
        used = np.flatnonzero(words)
        for i in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + (1 << 16)]), pa.array(words[used[i : i + (1 << 16)]])], names=["word", "bits"])

    words = lexicon.select("__key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return held


def _candidates(notes: DataFrame, lexicon: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """note_id, __key, start, end: n-grams that the map of the lexicon's keys does not rule out. sizes: how many keys have n tokens."""
    bits = min(SLOT_BITS, max(6, (16 * sum(sizes.values())).bit_length()))
    held = notes.sparkSession.sparkContext.broadcast(_key_map(lexicon, bits))
    chosen = notes.select("note_id", F.lower("text").alias("text"))
    integer = T.IntegerType()
    out = T.StructType([chosen.schema["note_id"], T.StructField("__key", T.StringType()), T.StructField("start", integer), T.StructField("end", integer)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, 1):
                row, start, end, strings = _scan(batch.column(1))
                coded = _coded(strings)
                for n in sorted(sizes):
                    many = len(row) - n + 1
                    if many <= 0:
                        break
                    first = np.flatnonzero(row[:many] == row[n - 1 :])
                    first = _ruled_in(first, _slots(coded, first, n, bits), held.value)
                    at = [strings.take(pa.array(first + k)) for k in range(n)]
                    gram = at[0] if n == 1 else pc.binary_join_element_wise(*at, " ")
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), gram, pa.array(start[first]), pa.array(end[first + n - 1])], names=out.names)

    return chosen.mapInArrow(run, out)


def _joined(notes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """note_id, start, end and the lexicon's columns but for `__key`: n-grams that equal a key."""
    sizes = {r["n"]: r["count"] for r in lexicon.groupBy(F.size(F.split("__key", " ")).alias("n")).count().collect()}
    return _candidates(notes, lexicon, sizes).join(lexicon, "__key").select("note_id", "start", "end", *(c for c in lexicon.columns if c != "__key"))


@lru_cache(1 << 16)
def _outer(mention: str) -> tuple[int, int]:
    """How many characters a mention has before its first and behind its last letter or digit (ASCII)."""
    bare = re.sub("^[^A-Za-z0-9]+", "", mention)
    return len(mention) - len(bare), len(bare) - len(re.sub("[^A-Za-z0-9]+$", "", bare))


def _joined_mentions(notes: DataFrame, lexicon: DataFrame, skip_prefix: int, raw: bool) -> DataFrame:
    """match_mentions() of a written lexicon by one pass over the notes and one shuffle of its candidates."""
    outer = lambda pattern: F.coalesce(F.max(F.length(F.regexp_extract("mention", pattern, 0))), F.lit(0))
    ahead, behind = lexicon.agg(outer("^[^A-Za-z0-9]+"), outer("[^A-Za-z0-9]+$")).first()
    sizes = {r["n"]: r["count"] for r in lexicon.groupBy(F.size(F.split("__key", " ")).alias("n")).count().collect()}
    bits = min(SLOT_BITS, max(6, (16 * sum(sizes.values())).bit_length()))
    held = notes.sparkSession.sparkContext.broadcast(_key_map(lexicon, bits))
    chosen = notes.select("note_id", F.lower("text").alias("text"), *([F.col("text").alias("raw")] if raw else []))
    string, integer = T.StringType(), T.IntegerType()
    found = T.StructType([chosen.schema["note_id"], *(T.StructField(c, k) for c, k in (("__key", string), ("__start", integer), ("__end", integer), ("__around", string), ("__header", string)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, 1):
                row, start, end, strings = _scan(batch.column(1))
                bare = pc.utf8_rtrim(strings, "s")
                inner, last = _coded(strings), _coded(bare)
                for n in sorted(sizes):
                    many = len(row) - n + 1
                    if many <= 0:
                        break
                    first = np.flatnonzero((row[:many] == row[n - 1 :]) & (start[:many] >= skip_prefix))
                    first = _ruled_in(first, _slots(inner, first, n, bits, last), held.value)
                    at = [strings.take(pa.array(first + k)) for k in range(n - 1)] + [bare.take(pa.array(first + n - 1))]
                    gram = at[0] if n == 1 else pc.binary_join_element_wise(*at, " ")
                    around, header, current, text, known = [], [], -1, "", {}
                    for r, s, e in zip(row[first].tolist(), start[first].tolist(), end[first + n - 1].tolist(), strict=True):
                        if r != current:
                            current, text, known = r, batch.column(batch.num_columns - 1)[r].as_py() or "", {}
                        around.append(text[max(0, s - ahead - 1) : e + behind + 1])
                        header.append("".join("01"[_ends_header_line(text, s - j, known)] for j in range(min(s, ahead) + 1)))
                    columns = [batch.column(0).take(pa.array(row[first])), gram, pa.array(start[first]), pa.array(end[first + n - 1])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(around, pa.string()), pa.array(header, pa.string())], names=found.names)

    kept = [f for f in lexicon.schema.fields if f.name != "__key"]
    # a mention's entries go through the decision as one row
    rest = [f.name for f in kept if f.name != "mention"]
    grouped = lexicon.repartition("__key").groupBy("__key", "mention").agg(F.collect_list(F.struct(*rest)).alias("__entries"))
    fields = [chosen.schema["note_id"], T.StructField("start", integer), T.StructField("end", integer), T.StructField("mention", string), grouped.schema["__entries"]]
    out = T.StructType([*fields, T.StructField("in_header", T.BooleanType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, begins, ends, inside = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("__start", "__end", "__around", "__header", "mention"))
            for i, (s, e, around, header, mention) in enumerate(zip(*columns, strict=True)):
                more, less = _outer(mention)
                a = min(s, ahead + 1) - more
                b = a + more + e - s + less
                if s - more < skip_prefix or a < 0 or not spelled(mention, around[a:b]):
                    continue
                if a > 0 and around[a - 1].isalnum() or around[b : b + 1].isalnum():
                    continue
                taken.append(i)
                begins.append(s - more)
                ends.append(e + less)
                inside.append(header[more] == "1")
            at = pa.array(taken, pa.int64())
            columns = [batch.column("note_id").take(at), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), batch.column("mention").take(at), batch.column("__entries").take(at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(inside, pa.bool_())], names=out.names)

    decided = chosen.mapInArrow(run, found).join(grouped, "__key").drop("__key").mapInArrow(decide, out)
    each = decided.select("note_id", "start", "end", "mention", F.explode("__entries").alias("__entry"), "in_header")
    return each.select("note_id", "start", "end", *("mention" if f.name == "mention" else f"__entry.{f.name}" for f in kept), "in_header")


def _passes(notes: DataFrame, lexicon: DataFrame, more: list[T.StructField], kernel, raw: bool = False, joined=None) -> DataFrame:
    """note_id, start, end, the lexicon's columns and `more`, of all shards: kernel(trie, shard, texts, row, start, end, strings)
    gives row, start, end, entry and the columns of `more`. joined: what takes the place of several shards."""
    lexicon, many = _kept(lexicon)
    if joined and many > 1:
        return joined(notes, lexicon)
    text = F.lower("text")
    chosen = notes.select("note_id", text.alias("text"), *([F.col("text").alias("raw")] if raw else []))
    kept = [f for f in lexicon.schema.fields if f.name != "__key"]
    integer = T.IntegerType()
    out = T.StructType([chosen.schema["note_id"], T.StructField("start", integer), T.StructField("end", integer), *kept, *more])

    def one(shard: pa.Table) -> DataFrame:
        held = notes.sparkSession.sparkContext.broadcast((Trie(shard.column("__key").combine_chunks()), shard.drop(["__key"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, entries = held.value
            for whole in batches:
                for batch in _pieces(whole, 1):
                    row, start, end, entry, extra = kernel(trie, entries, batch.column(batch.num_columns - 1), *_scan(batch.column(1)))
                    columns = [c.combine_chunks() for c in entries.take(pa.array(entry)).columns]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *columns, *extra], names=out.names)

        return chosen.mapInArrow(run, out)

    parts = [one(shard) for shard in _shards(lexicon, many)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def match_terms(notes: DataFrame, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """note_id, start, end and the lexicon's columns: every run of tokens that, joined by spaces, equals a term."""

    def kernel(trie, entries, texts, row, start, end, strings):
        ids = trie.ids(strings)
        first, last, entry = trie.find(row, ids, ids)
        return row[first], start[first], end[last], entry, []

    return _passes(notes, lexicon.withColumn("__key", F.col(term)), [], kernel, joined=_joined)


#: choose(note, start, end, order, column) of the hits of some whole notes, sorted by (note, start, end): places of those taken, and
#: what more columns have there. order: of a hit in its note, from 0; column(name): the hits' values of a column of the lexicon.
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[str], pa.Array]], tuple[np.ndarray, list[np.ndarray]]]


def longest_terms(notes: DataFrame, lexicon: DataFrame, weight: str, term: str = "term", named: bool = True) -> DataFrame:
    """longest_wins() of match_terms(): note_id, start, end, the lexicon's columns but for `weight`, and ord; not named: without `term`."""

    def longest(note, start, end, order, column):
        return longest_of(start, end, order, chain_bounds(note, start, end)), []

    return chosen_terms(notes, lexicon, weight, longest, term, named)


def chosen_terms(notes: DataFrame, lexicon: DataFrame, weight: str, choose: Choice, term: str = "term", named: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """Those of match_terms() that `choose` takes, note by note: note_id, start, end, the lexicon's columns but for `weight`, ord and the
    integers of `more`; not named: without `term`.

    weight: how often a term is expected. The terms of most weight, as many as HEAVY_SHARDS shards hold, are a trie; only n-grams that
    may be one of the others are shuffled and joined. What is found of them meets the texts by note, where the trie finds the rest
    and the choice is made: frequent hits never become rows, and no hits are sorted. A task holds the texts of some whole
    notes, at most one batch and the note behind it.
    """
    kept = [c for c in lexicon.columns if c != weight and (named or c != term)]
    lexicon = cut_lineage(lexicon.where(F.col(term).isNotNull() & (F.col(term) != "")))
    heavy_by = F.least(F.coalesce(F.col(weight), F.lit(0)), F.lit(WEIGHTS)).cast("bigint")
    counts = lexicon.groupBy(heavy_by.alias("w"), F.size(F.split(term, " ")).alias("k")).agg(F.count("*").alias("n"), F.sum(_entry_bytes(lexicon) + F.octet_length(term)).alias("b")).collect()
    least, used = WEIGHTS + 1, 0
    for w in sorted({r["w"] for r in counts}, reverse=True):
        used += sum(r["b"] for r in counts if r["w"] == w)
        if used > HEAVY_SHARDS * SHARD_BYTES:
            break
        least = w
    sizes: dict[int, int] = {}
    for r in counts:
        if r["w"] < least:
            sizes[r["k"]] = sizes.get(r["k"], 0) + r["n"]
    heavy = lexicon.where(heavy_by >= least).select(F.col(term).alias("__key"), *kept).toArrow().combine_chunks()
    held = notes.sparkSession.sparkContext.broadcast((Trie(heavy.column("__key").combine_chunks()), heavy.drop(["__key"])))
    fields = [lexicon.schema[c] for c in kept]
    integer = T.IntegerType()
    out = T.StructType([notes.schema["note_id"], T.StructField("start", integer), T.StructField("end", integer), *fields, *(T.StructField(c, integer) for c in ("ord", *more))])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    both = notes.select("note_id", F.coalesce(F.lower("text"), F.lit("")).alias("__text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), *none)
    if sizes:
        light = lexicon.where(heavy_by < least).select(F.col(term).alias("__key"), *(c for c in kept if c != term))
        found = _candidates(notes, light, sizes).join(light, "__key").withColumnRenamed("__key", term)
        both = both.unionByName(found.select("note_id", F.lit(None).cast("string").alias("__text"), "start", "end", *kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []  # of notes to come, the last one unfinished
        held_bytes = 0
        for batch in batches:
            if not len(batch):
                continue
            begins = np.flatnonzero(_changes(batch.column(0)))
            goes_on = bool(rows) and rows[-1].column(0)[len(rows[-1]) - 1].as_py() == batch.column(0)[0].as_py()
            if held_bytes >= PIECE_BYTES and not (goes_on and len(begins) == 1):
                yield from done([*rows, batch.slice(0, begins[-1])])
                rows, held_bytes, batch = [], 0, batch.slice(begins[-1])
            rows.append(batch)
            held_bytes += batch.nbytes
        yield from done(rows)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else ():
            changed = _changes(batch.column(0))
            note, begins = np.cumsum(changed), np.flatnonzero(changed)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(size) - size)[begins] // PIECE_BYTES
            cuts = [*begins[np.append(True, piece[1:] != piece[:-1])].tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield taken(batch.slice(a, b - a), note[a:b])

    def taken(part: pa.RecordBatch, note: np.ndarray) -> pa.RecordBatch:
        trie, entries = held.value
        is_text = pc.is_valid(part.column(1)).to_numpy(zero_copy_only=False)
        texts, hits = np.flatnonzero(is_text), np.flatnonzero(~is_text)
        row, start, end, strings = _scan(part.column(1).take(pa.array(texts)))
        ids = trie.ids(strings)
        first, last, entry = trie.find(row, ids, ids)
        joined = part.take(pa.array(hits))
        of = np.concatenate([texts[row[first]], hits])
        start = np.concatenate([start[first], joined.column(2).to_numpy(zero_copy_only=False).astype(np.int32)])
        end = np.concatenate([end[last], joined.column(3).to_numpy(zero_copy_only=False).astype(np.int32)])
        by = np.lexsort((end, start, note[of]))
        of, start, end = of[by], start[by], end[by]
        order = order_in_row(note[of]).astype(np.int32)
        column = lambda c, at=by: pa.concat_arrays([entries.column(c).take(pa.array(entry)).combine_chunks(), joined.column(c)]).take(pa.array(at))
        left, extra = choose(note[of], start, end, order, column)
        columns = [part.column(0).take(pa.array(of[left])), pa.array(start[left]), pa.array(end[left]), *(column(c, by[left]) for c in kept), pa.array(order[left])]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in extra)], names=out.names)

    return both.repartition("note_id").sortWithinPartitions("note_id").mapInArrow(run, out)


def _changes(notes: pa.Array) -> np.ndarray:
    code = pc.fill_null(notes.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.append(True, code[1:] != code[:-1])[: len(code)]


def match_alternatives(notes: DataFrame, lexicon: DataFrame, order: str = "dict_ord", term: str = "term") -> DataFrame:
    """match_terms() with the first alternative (lowest `order`) of each start alone, within each shard."""

    def kernel(trie, entries, texts, row, start, end, strings):
        ids = trie.ids(strings)
        first, last, entry = trie.find(row, ids, ids)
        rank = entries.column(order).to_numpy()[entry]
        by = np.lexsort((rank, first))
        by = by[np.append(True, np.diff(first[by]) > 0)[: len(by)]]
        return row[first[by]], start[first[by]], end[last[by]], entry[by], []

    return _passes(notes, lexicon.withColumn("__key", F.col(term)), [], kernel)


def _ends_header_line(text: str, at: int, known: dict[int, bool]) -> bool:
    """Whether the text up to the next line feed behind `at`, trimmed, ends with a colon; without one, up to the end."""
    feed = text.find("\n", at)
    feed = len(text) if feed < 0 else feed
    if feed not in known:
        back = feed
        while back and text[back - 1] in _SPACE:
            back -= 1
        known[feed] = back > 0 and text[back - 1] == ":"
    return known[feed]


def match_mentions(notes: DataFrame, lexicon: DataFrame, max_n: int | None = None, skip_prefix: int = 0, case_sensitive: bool = False) -> DataFrame:
    """note_id, start, end, the lexicon's columns and in_header: matches of `mention` as spelling() reads it, at word boundaries.

    Candidates are runs of tokens with the mention's folded key; the spelling then decides on the text itself, lower-cased
    or as it is. max_n: mentions of more tokens don't match.
    """
    keyed = lexicon.withColumn("__key", fold(F.col("mention")))
    if max_n:
        keyed = keyed.where(F.size(F.split("__key", " ")) <= max_n)

    def kernel(trie, entries, texts, row, start, end, strings):
        first, last, entry = trie.find(row, trie.ids(strings), trie.ids(pc.utf8_rtrim(strings, "s")))
        order = np.lexsort((last, first))
        first, last, entry = first[order], last[order], entry[order]
        mentions = entries.column("mention").take(pa.array(entry)).to_pylist()
        kept, begins, ends, header = [], [], [], []
        current, text, known = -1, "", {}
        for i, (r, s, e, mention) in enumerate(zip(row[first].tolist(), start[first].tolist(), end[last].tolist(), mentions, strict=True)):
            if r != current:
                current, text, known = r, texts[r].as_py() or "", {}
            ahead, behind = _outer(mention)
            s, e = s - ahead, e + behind
            if s < skip_prefix or not spelled(mention, text[max(s, 0) : e]):
                continue
            if s > 0 and text[s - 1].isalnum() or text[e : e + 1].isalnum():
                continue
            kept.append(i)
            begins.append(s)
            ends.append(e)
            header.append(_ends_header_line(text, s, known))
        at = np.array(kept, np.int64)
        return row[first[at]], begins, ends, entry[at], [pa.array(header, pa.bool_())]

    joined = lambda notes, lexicon: _joined_mentions(notes, lexicon, skip_prefix, case_sensitive)
    return _passes(notes, keyed, [T.StructField("in_header", T.BooleanType())], kernel, raw=case_sensitive, joined=joined)
