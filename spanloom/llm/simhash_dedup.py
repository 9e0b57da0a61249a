"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, so two of them at 4 or fewer differing bits have at least 4 of their 8 bytes in common at the
same positions. The postings of the index are keyed by positions and their bytes. A posting of one byte holds 1/256 of all
fingerprints; so that postings stay short, a key here takes a few positions at once, chosen so that each set of 4 matching
positions contains one of them: 7 pairs of positions up to 2**19 fingerprints, 20 triples up to 2**27, all 70 quadruples
beyond. Each choice finds the same links. Within a posting the shared positional bytes of a pair are tallied, pairs with
at least 4 are kept, and their differing bits are counted.

The index holds distinct fingerprints, so copies cost nothing. A posting of more than BLOCK fingerprints is cut into blocks
whose pairs go to different tasks. A posting gives its links as a spanning forest, never as all pairs: components are the
same. They come from star rounds over the forests. Rows find their component by an exchange on the fingerprint; those of
hot ones (components.HOT_ROWS) by a broadcast of these few. Only counts reach the driver.

Null text has no words and, like any text without words, the fingerprint zero. Repeated rows and equal texts share a
fingerprint and so a component. A null id is no candidate for component_id, which is null where no row of a component has
an id. Ties of ids are described at one_row_of_each(). Very long texts are read whole, in pieces. An empty table gives an
empty result. Other columns are not read and may have any name, but for ROW in one_of_each().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, shared_folder, spark_schema
from .components import connected_components, join_spread

SEED = 42
#: The column that names a row, where ids may repeat.
ROW = "__row_hash"
BYTES = 8
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Fingerprints of a posting, or of a block of one, that a task compares at once.
BLOCK = 4096
SMALL = 24


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in pieces: memory is bounded but for the lowered text."""
    low, at, held, some = text.translate(LOWER), 0, [], False
    while at < len(low):
        blank = BLANK.search(low, at + PIECE)
        end = blank.start() if blank else len(low)
        found, at = held + low[at:end].split(), end
        held = found[max(0, len(found) - words + 1) :]
        if len(found) < words:
            continue
        some = True
        flat = b" ".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(found) - words + 1]
        shingles = [flat[s:e] for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 where there is no word."""
    return majorities(shingle_hashes(text, words))


def majorities(hashes: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have set; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _kernel(texts: list[bytes], words: int) -> list:
    return [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    return map_texts(df, lambda texts: _kernel(texts, words), "fp long", id_col, text_col, as_bytes=True)


def covering(size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions of which each set of 4 positions contains at least one."""
    groups = (range(0, 3), range(3, 6), range(6, 8))
    group = {p: g for g, ps in enumerate(groups) for p in ps}
    if size == 2:
        return [c for c in combinations(range(BYTES), 2) if group[c[0]] == group[c[1]]]
    if size == 3:
        # three of a group, or two of a group and one of the next
        wanted = {(g, g, g) for g in range(3)} | {tuple(sorted((g, g, (g + 1) % 3))) for g in range(3)}
        return [c for c in combinations(range(BYTES), 3) if tuple(sorted(group[p] for p in c)) in wanted]
    return list(combinations(range(BYTES), size))


def positions_for(n: int) -> int:
    """Positions in a key for n fingerprints, so that a posting of spread-out ones stays below about ten."""
    return 2 if n <= 1 << 19 else 3 if n <= 1 << 27 else 4


def postings(fps: DataFrame, size: int) -> DataFrame:
    """key, fp for each key of a fingerprint."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, places in enumerate(covering(size)):
        key = F.lit(k).cast("bigint")
        for p in places:
            key = key * 256 + byte(p)
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    """Of differences x (xor): whether the shared positional bytes reach the guaranteed minimum, then the bits verified."""
    tally = (x[:, None].view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    kept = np.flatnonzero(tally >= BYTES - bits)
    return kept[np.bitwise_count(x[kept]) <= bits]


def forest(fp: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (equal values, adjacent) as edges that keep their components."""
    bound = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(fp))
    size = np.diff(bound)
    us, vs = [], []
    small = np.repeat(size <= SMALL, size)
    end = np.repeat(bound[1:], size)
    at = np.flatnonzero(small)
    for lag in range(1, SMALL):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        hit = at[_linked(fp[at] ^ fp[at + lag], bits)]
        us.append(fp[hit])
        vs.append(fp[hit + lag])
    for g in np.flatnonzero(size > SMALL).tolist():
        # breadth first over what is not reached yet: each node is reached once, by one edge
        left = np.unique(fp[bound[g] : bound[g + 1]])
        queue: list = []
        while len(left) or queue:
            if not queue:
                queue, left = [left[0]], left[1:]
            node = queue.pop()
            hit = np.zeros(len(left), bool)
            hit[_linked(left ^ node, bits)] = True
            if hit.any():
                us.append(np.full(hit.sum(), node))
                vs.append(left[hit])
                queue.extend(left[hit])
                left = left[~hit]
            if not len(left):
                break
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def in_blocks(rows: DataFrame, member: str, size: int | None = None) -> DataFrame:
    """rows (key and others) dealt so that a task gets two blocks of a key's rows at a time: columns key, lo, hi first.

    A key of up to `size` (BLOCK) rows is one group. Of a longer one every pair of blocks, by a hash of `member`, is a group of its
    own, so that all pairs of the key meet but no task holds the key.
    """
    size = size or BLOCK
    hot = rows.groupBy("key").count().where(F.col("count") > size)
    hot = hot.select("key", F.ceil(F.col("count") / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    cut = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.select(*rows.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    others = [c for c in rows.columns if c != "key"]
    dealt = cut.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *others)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", member)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Tables of about `rows` rows that end where a group (key, lo, hi) ends, with the number of each row's group."""

    def numbered(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
        of = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(3)])
        return np.cumsum(np.append(False, (of[:, 1:] != of[:, :-1]).any(axis=0))), table

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= rows:
            group, table = numbered(pa.Table.from_batches(held))
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield group[:cut], table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield numbered(pa.Table.from_batches(held))


def links(fps: DataFrame, bits: int = 4, size: int | None = None) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp), as forests of the postings. size: positions in a key; by
    default positions_for() the number of fingerprints. Every size finds the same links."""
    bound_batches(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in whole_groups(batches, 1 << 17):
            u, v = forest(rows.column("fp").to_numpy().view(np.uint64), group, bits)
            for i in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].view(np.int64)) for x in (u, v)], names=["u", "v"])

    keys = postings(fps, size or positions_for(fps.count()))
    return in_blocks(keys, "fp").mapInArrow(run, spark_schema("u long,v long"))


def components(each: DataFrame, firsts: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Each row of `each` with component_id, the smallest doc_id reachable from its node; null where no id is reachable.

    firsts: one row per node with first_id (smallest doc_id) and n_rows, the number of its rows; edges: u, v between nodes.
    """
    firsts = firsts.checkpoint()
    roots = connected_components(edges)
    members = roots.select(F.col("u").alias(node), "root").unionByName(roots.select(F.col("root").alias(node), "root").distinct())
    least = members.join(firsts, node).groupBy("root").agg(F.min("first_id").alias("least_id"))
    grouped = firsts.join(members.join(least, "root").select(node, "root", "least_id"), node, "left")
    of_component = F.when(F.col("root").isNotNull(), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id")
    grouped = grouped.select(node, "n_rows", F.coalesce("root", node).alias("component"), of_component).checkpoint()
    return join_spread(each, grouped, node, each.count()).drop("n_rows")


def row_key(df: DataFrame) -> DataFrame:
    """df with a hash of all its columns as ROW, which names a row where ids repeat; equal rows share it."""
    return df.withColumn(ROW, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))


def labelled(df: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component (a fingerprint), component_id and the columns of `carry`, per row of df."""
    if not 0 <= bits <= 4:
        raise ValueError("the index is built for up to 4 differing bits")
    shared_folder(df.sparkSession)
    each = map_texts(df, lambda texts: _kernel(texts, words), "fp long", id_col, text_col, as_bytes=True, carry=carry).checkpoint()
    firsts = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")).checkpoint()
    return components(each, firsts, links(firsts.select("fp"), bits), "fp")


def near_duplicates(df: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links), per row of df."""
    found = labelled(df, words, bits, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component of near_duplicates(); see one_row_of_each()."""
    return one_row_of_each(df, labelled(row_key(df), words, bits, id_col, text_col, carry=(ROW,)))


def one_row_of_each(df: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id (null comes last), among such rows the one with the smallest hash of
    all columns, of equal rows one. found: doc_id, component, component_id and ROW per row of row_key(df). Decided per
    row: of two rows that share an id but not a component, each stands for its own.
    """
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", ROW).count()
    kept = least.groupBy("component").agg(F.min(ROW).alias(ROW), F.min_by("count", ROW).alias("n"))
    kept = kept.select(ROW, "n").checkpoint()
    rows = row_key(df)
    once = rows.join(kept.where("n = 1"), ROW, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
    if not kept.where("n > 1").limit(1).count():
        return once
    again = rows.join(kept.where("n > 1"), ROW, "left_semi").dropDuplicates([ROW])
    return once.unionByName(again.select(*(F.col(f"`{c}`") for c in df.columns)))
