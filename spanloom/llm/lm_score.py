"""Language-model scores by Stupid Backoff with counts of the whole corpus but the document itself.

An n-gram can occur in another document only if the shorter ones in it do. So counts are asked for in rounds: words and
pairs first, then each longer n-gram only where the two shorter ones in it occur elsewhere; the others' counts are zero.

The corpus is dealt to blocks of about BLOCK_BYTES by a hash of its rows. A block's n-grams (orders 0 to `order`; order 0 is
the empty n-gram, which counts tokens) are named by 64-bit hashes and counted once per block, so a frequent n-gram is one
entry of a block however often it occurs. The entries are partitioned by ranges of the hash; each range's count table is
joined to the entries of all blocks (sorted together, equal hashes summed), and the totals go back to the blocks, where each n-gram occurrence takes its total
less the document's own count, and the logarithms are summed per document:

    S(w | context) = c(context w) / c(context) if c(context w) > 0, else ALPHA * S(w | shorter context)

At the empty context a word that no other document has counts ALPHA once more and one occurrence. Words are split at ASCII
white space after A to Z are lowered. An n-gram doesn't reach over a document's start; there is no start mark.

Hashes of 64 bits: among n distinct n-grams about n * n / 2**65 pairs fall together and share their counts.
A message holds the hashes of a block in a range. Their number grows with the square of the input until messages hold few
hashes each, and in proportion to the hashes from there on, of which it can't be more. Packing them is what keeps the shuffle small: a row of its own for each (hash, block, count) takes
some three times the bytes, on disk twice a round.

Null text counts as empty: no tokens, score and mean 0. Repeated rows are documents of their own, each scored with the
others' counts; rows that repeat with their id share a block, so a block may be larger than BLOCK_BYTES by these. Ties don't
arise. Very long texts are taken whole. An empty table gives an empty result. Other columns are not read and may have any
name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spark_schema

ALPHA = 0.4
ORDER = 3
BLOCK_BYTES = 4 << 20
#: A range of hashes holds as many distinct n-grams as so many blocks: messages between blocks and ranges stay few and long.
BLOCKS_A_PART = 4
#: Text that a task holds to compress what goes to the same block together.
BUNDLE_BYTES = 16 << 20
EMPTY = np.uint64(0)  # the key of order 0


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Level:
    """The n-grams of one length at the tokens `at`: group of each token, its hash, count and number in the token's document."""

    def __init__(self, block: Block, at: np.ndarray, before: Level | None):
        bits_w, bits_d = (int(max(n - 1, 1)).bit_length() for n in (len(block.hashes), len(block.sizes)))
        word = block.words[at]
        name = word if before is None else (before.group[at - 1] << bits_w) | word
        name = (name << bits_d) | block.doc[at]
        order = np.argsort(name)
        name = name[order]
        own = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        name >>= bits_d
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        self.count = np.diff(np.append(start, len(name)))
        place = at[order]
        self.group, self.own = np.full(len(block.words), -1), np.zeros(len(block.words), np.int64)
        self.group[place] = np.repeat(np.arange(len(start)), self.count)
        size = np.diff(np.append(own, len(name)))
        self.own[place] = np.repeat(size, size)
        first = place[start]
        self.hash = block.hashes[block.words[first]]
        if before is not None:
            self.hash = _mixed(before.hash[before.group[first - 1]] + np.uint64(0x9E3779B97F4A7C15)) + self.hash
        self.at = at


class Block:
    """Tokens of some texts, and what is known of their n-grams."""

    def __init__(self, texts: pa.Array, order: int):
        # Arrow lowers A to Z, splits at ASCII white space and numbers the words; blanks at the ends make empty words
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.doc = owner[full.to_numpy(zero_copy_only=False)]
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        coded = flat.filter(full).dictionary_encode()
        self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
        del lists, flat, full, owner, coded
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.rounds = [(1, 2)[:order], *((k,) for k in range(3, order + 1))]
        self.levels: list[Level] = []
        self.others: list[np.ndarray] = []  # of each order, per token: occurrences in other documents

    def entries(self, totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct keys in order and their counts to ask for next, given the corpus counts of those asked for before."""
        for r, lengths in enumerate(self.rounds):
            for k in lengths:
                there = self.place >= k - 1
                if k > 2:
                    more = self.others[k - 1] > 0
                    there &= more
                    there[1:] &= more[:-1]
                self.levels.append(Level(self, np.flatnonzero(there), self.levels[-1] if k > 1 else None))
            now = self.levels[-len(lengths) :]
            keys = np.concatenate([np.maximum(_mixed(x.hash ^ np.uint64(k)), np.uint64(1)) for k, x in zip(lengths, now, strict=True)])
            order = np.argsort(keys)
            if r == len(totals) and (len(keys) or r == 0):
                keys, counts = keys[order], np.concatenate([x.count for x in now])[order]
                return (np.append(EMPTY, keys), np.append(len(self.words), counts)) if r == 0 else (keys, counts)
            found = totals[r] if r < len(totals) else np.zeros(0, np.int64)
            if r == 0:
                self.others = [(found[0] - self.sizes)[self.doc]]
                found = found[1:]
            back = np.empty(len(keys), np.int64)
            back[order] = found
            for x in now:
                mine, back = back[: len(x.count)], back[len(x.count) :]
                c = np.zeros(len(self.words), np.int64)
                c[x.at] = mine[x.group[x.at]] - x.own[x.at]
                self.others.append(c)
        return None

    def scores(self, totals: list[np.ndarray]) -> np.ndarray:
        """Sum of log S of each text. totals: corpus counts for each round of entries()."""
        self.entries(totals)
        n = len(self.words)
        log, left, backs = np.zeros(n), np.ones(n, bool), np.zeros(n)
        for k in range(len(self.others) - 1, 0, -1):
            hit = np.flatnonzero(left & (self.others[k] > 0))
            context = self.others[k - 1][hit - 1] if k > 1 else self.others[0][hit]
            log[hit] = np.log(self.others[k][hit] / context) + backs[hit] * math.log(ALPHA)
            left[hit] = False
            backs[left & (self.place >= k - 1)] += 1
        log[left] = backs[left] * math.log(ALPHA) - np.log(np.maximum(self.others[0][left], 1))
        return np.bincount(self.doc, log, minlength=len(self.sizes))


def pack(values: np.ndarray) -> bytes:
    """Numbers of 8 or 4 bytes as planes of their bytes, compressed: high planes are mostly zeros."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ranges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the ranges that have keys."""
    part = part_of(keys, parts)
    start = np.flatnonzero(np.append(True, np.diff(part) > 0))
    return list(zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True))


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) as rows (block, ids, sizes, data): the texts of a block that stand near, compressed as one."""
    zip_ = zstandard.ZstdCompressor(level=3, write_checksum=False).compress

    def bundled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        whole = whole.take(np.argsort(whole.column("block").to_numpy(), kind="stable"))
        block = whole.column("block").to_numpy()
        texts = pc.fill_null(whole.column("text").cast(pa.large_binary()), b"")
        start = np.flatnonzero(np.append(True, np.diff(block) != 0))
        bound = list(zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True))
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        offsets = pa.array(np.append(start, len(block)), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, whole.column("doc_id").combine_chunks())
        data = [zip_(b"".join(texts.slice(a, b - a).to_pylist())) for a, b in bound]
        return pa.RecordBatch.from_arrays([pa.array(block[start]), ids, pa.ListArray.from_arrays(offsets, pa.array(sizes)), pa.array(data, pa.binary())], names=["block", "ids", "sizes", "data"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BUNDLE_BYTES:
            yield bundled(held)
            held, size = [], 0
    if any(len(b) for b in held):
        yield bundled(held)


def _unbundle(rows: pa.Table) -> tuple[pa.Array, pa.Array]:
    """ids and texts of a block's rows."""
    data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in rows.column("data").to_pylist())
    sizes = rows.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))
    return rows.column("ids").combine_chunks().flatten(), texts


def score_documents(df: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (sum of log S, six decimals), mean_score of each row."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    parts = -(-blocks // BLOCKS_A_PART)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(_bundle, spark_schema("block int,ids array<long>,sizes array<long>,data binary")).repartition("block")

    def totals_of(answers) -> list[np.ndarray]:
        """By round, the corpus counts that came back to a block."""
        found = sorted(zip(*(answers.column(c).to_pylist() for c in ("round", "part", "totals")), strict=True), key=lambda x: x[:2])
        rounds = sorted({r for r, _, _ in found})
        return [np.concatenate([unpack(x, np.uint64) for i, _, x in found if i == r]).astype(np.int64) for r in rounds]

    def ask(block: int, texts, totals: list[np.ndarray], round_: int):
        keys, counts = Block(texts, order).entries(totals) or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        found = _ranges(keys, parts) if len(keys) else []
        return pa.table({
            "round": pa.array([round_] * len(found), pa.int32()),
            "part": pa.array([p for p, _, _ in found], pa.int32()),
            "block": pa.array([block] * len(found), pa.int32()),
            "entries": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in found], pa.binary()),
            "counts": pa.array([pack(counts[a:b].astype(np.uint32)) for _, a, b in found], pa.binary()),
        })

    def answer(key, whole):
        lists = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in whole.column("entries").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in whole.column("counts").to_pylist()])
        bound = np.cumsum([len(x) for x in lists])[:-1]
        _, where = np.unique(np.concatenate(lists), return_inverse=True)
        table = np.bincount(where, counts)  # the count table of this range
        totals = np.split(table[where].astype(np.uint64), bound)
        return pa.table({"block": whole.column("block"), "round": whole.column("round"), "part": whole.column("part"), "totals": pa.array([pack(x) for x in totals], pa.binary())})

    def score(key, left, right):
        ids, texts = _unbundle(left)
        block = Block(texts, order)
        sums = block.scores(totals_of(right))
        n = block.sizes
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n), "score": pa.array(np.round(sums, 6)), "mean_score": pa.array(np.round(sums / np.maximum(n, 1), 6))})

    def ask_more(round_: int):
        return lambda key, left, right: ask(key[0].as_py(), _unbundle(left)[1], totals_of(right), round_)

    asked_as, answered_as = spark_schema("round int,part int,block int,entries binary,counts binary"), spark_schema("block int,round int,part int,totals binary")
    answered = None
    for r in range(max(1, order - 1)):
        if answered is None:
            asked = dealt.groupBy("block").applyInArrow(lambda key, whole: ask(key[0].as_py(), _unbundle(whole)[1], [], 0), asked_as)
        else:
            asked = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask_more(r), asked_as)
        now = asked.groupBy("part").applyInArrow(answer, answered_as)
        answered = now if answered is None else answered.unionByName(now)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, spark_schema("doc_id long,n_tokens long,score double,mean_score double"))


def scores_sql(order: int = ORDER) -> str:
    """The same in SQL over the table documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = "\nUNION ALL\n".join(f"SELECT {k} AS k, row_id, i, {'w' if k == 1 else ' || chr(10) || '.join([f'lag(w, {j}) OVER (PARTITION BY row_id ORDER BY i)' for j in range(k - 1, 0, -1)] + ['w'])} AS gram FROM words" for k in range(1, order + 1))
    pick = f"backs * ln({ALPHA}) - ln(greatest(c0, 1))"
    for k in range(1, order + 1):
        context = "c0" if k == 1 else f"b{k - 1}"
        lost = f"(CASE WHEN n_back > {k} THEN n_back - {k} ELSE 0 END)"
        pick = f"CASE WHEN c{k} > 0 THEN ln(c{k} / {context}) + {lost} * ln({ALPHA}) ELSE {pick} END" if k else pick
    columns = ", ".join(f"max(c) FILTER (k = {k}) AS c{k}" for k in range(1, order + 1))
    shifted = "".join(f", lag(c{k}) OVER (PARTITION BY row_id ORDER BY i) AS b{k}" for k in range(1, order))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT row_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts),
grams AS ({grams}),
own AS (SELECT k, gram, row_id, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL),
whole AS (SELECT k, gram, sum(n) AS n FROM own GROUP BY ALL),
less AS (SELECT own.k, own.gram, own.row_id, (whole.n - own.n)::DOUBLE AS c FROM own JOIN whole USING (k, gram)),
wide AS (SELECT row_id, i, {columns}, max(k) AS n_back FROM grams JOIN less USING (k, gram, row_id) GROUP BY row_id, i),
sizes AS (SELECT row_id, doc_id, len(ws) AS n, (sum(len(ws)) OVER () - len(ws))::DOUBLE AS c0 FROM texts),
ready AS (SELECT row_id, n_back AS backs, c0, {", ".join(f"c{k}" for k in range(1, order + 1))}, n_back{shifted} FROM wide JOIN sizes USING (row_id)),
logs AS (SELECT row_id, sum({pick}) AS s FROM ready GROUP BY row_id)
SELECT doc_id, n::BIGINT AS n_tokens, round(coalesce(s, 0), 6) AS score, round(coalesce(s, 0) / greatest(n, 1), 6) AS mean_score FROM sizes LEFT JOIN logs USING (row_id)
"""
