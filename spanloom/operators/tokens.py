"""Tokens and n-grams with offsets as tables, by one Arrow kernel over the bytes of many notes: no shuffle, no window.

A token is a run of a-z and 0-9 in the lower-cased text; offsets are code points of it. Lower-casing must keep the length, as
it does but for a few letters such as a dotted capital I. Null and empty texts have no token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the kernel takes at once; a longer text stands alone.
PIECE_BYTES = 4 << 20
#: The same where no lexicon is looked into, so that small pieces cost nothing: a piece's arrays take some 25 times its bytes.
MAP_BYTES = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `size` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def last_of_row(row: np.ndarray) -> np.ndarray:
    return np.append(row[1:] != row[:-1], True)[: len(row)]


def order_in_row(row: np.ndarray) -> np.ndarray:
    """The number of each token within its row; rows come one after the other."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    return np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def _pairs(flat: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray | None = None) -> pa.Array:
    """The text from each token (that is wanted) to the end of the row's next one; null for a row's last token."""
    last = last_of_row(row) if wanted is None else last_of_row(row) | ~wanted
    size = np.where(last, 0, np.append(end[1:], 0)[: len(row)] - begin)
    bound = np.append(0, np.cumsum(size))
    at = np.arange(bound[-1]) + np.repeat(begin - bound[:-1], size)
    valid = pa.array(~last).buffers()[1]
    return pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(bound), pa.py_buffer(flat[at].tobytes()), valid).cast(pa.string())


def _scan(texts: pa.Array, pairs: bool = False, wanted=None) -> tuple:
    """Row, start, end and string of each token of lower-cased texts; with `pairs` also what _pairs() gives, for the tokens that
    wanted(row) marks."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word = _WORD[flat]
    before, behind = np.append(False, word)[:-1], np.append(word, False)[1:]
    inner = offsets[(offsets > 0) & (offsets < len(flat))]
    before[inner], behind[inner - 1] = False, False
    begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, offsets)))
    strings = pa.array([], pa.string())
    if len(begin):
        bound = np.append(0, np.cumsum(end - begin)).astype(np.int32)
        strings = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bound), pa.py_buffer(flat[word].tobytes()))
    more = (_pairs(flat, row, begin, end, wanted(row) if wanted else None),) if pairs else ()
    if len(flat) and flat.max() >= 128:
        place = np.append(0, np.cumsum((flat & 0xC0) != 0x80))
        first = place[offsets[row]]
        return row, (place[begin] - first).astype(np.int32), (place[end] - first).astype(np.int32), strings, *more
    return row, (begin - offsets[row]).astype(np.int32), (end - offsets[row]).astype(np.int32), strings, *more


def _map(notes: DataFrame, keep: tuple[str, ...], more: list[tuple[str, T.DataType]], kernel, pairs: bool = False) -> DataFrame:
    """note_id and `keep` of a token's row before the columns that kernel(row, start, end, strings) gives in runs."""
    chosen = notes.select("note_id", *keep, F.lower("text").alias("text"))
    given = chosen.schema.fields[:-1]
    out = T.StructType([*given, *(T.StructField(name, kind) for name, kind in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, len(given), MAP_BYTES):
                for row, columns in kernel(*_scan(batch.column(len(given)), pairs)):
                    of = [batch.column(i).take(pa.array(row)) for i in range(len(given))]
                    yield pa.RecordBatch.from_arrays([*of, *columns], names=out.names)

    return chosen.mapInArrow(run, out)


def token_table(notes: DataFrame, keep: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """note_id, the columns of `keep`, ord (from 0), tok, start, end of each token, and next_end: the end of the note's next
    token, null behind the last one. With `pairs` also `pair`, the lower-cased text up to there: spans made of tokens have
    their surface from the pass that finds them, and need no text again."""

    def kernel(row, start, end, strings, *more):
        following = pa.array(np.append(end[1:], 0)[: len(row)].astype(np.int32), mask=last_of_row(row))
        yield row, [pa.array(order_in_row(row).astype(np.int32)), strings, pa.array(start), pa.array(end), following, *more]

    integer = T.IntegerType()
    columns = [("ord", integer), ("tok", T.StringType()), ("start", integer), ("end", integer), ("next_end", integer)]
    return _map(notes, keep, columns + [("pair", T.StringType())] * pairs, kernel, pairs)


def ngram_table(notes: DataFrame, max_n: int, lengths: list[int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """note_id, the columns of `keep`, n, gram, start, end of the n-grams of 1 to max_n tokens (or of the lengths given)."""
    sizes = list(lengths or range(1, max_n + 1))

    def kernel(row, start, end, strings):
        for n in sizes:
            many = len(row) - n + 1
            if many <= 0:
                continue
            whole = np.flatnonzero(row[:many] == row[n - 1 :])
            at = [strings.take(pa.array(whole + k)) for k in range(n)]
            gram = at[0] if n == 1 else pc.binary_join_element_wise(*at, " ")
            yield row[whole], [pa.array(np.full(len(whole), n, np.int32)), gram, pa.array(start[whole]), pa.array(end[whole + n - 1])]

    integer = T.IntegerType()
    return _map(notes, keep, [("n", integer), ("gram", T.StringType()), ("start", integer), ("end", integer)], kernel)
