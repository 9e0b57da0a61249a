"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, turn by turn in the order (turn, role, text):

    ### role
    text</turn>

Inside roles and texts a backslash is put before each backslash, "### ", "<turn>" and "</turn>"; a line feed in a role is
written as backslash and n. This is reversible. The rendered string is encoded once with offsets; the sorted spans of
turns that count for the loss are met with the sorted token spans by binary search, and the mask holds the parts of tokens
inside such a turn's text. Text under the mask and the turns are read back from the rendered string alone.

Rows stream through a worker in the order of conversations, and a worker holds one segment of at most SEGMENT characters
(or one turn) at a time: a boundary between turns is a token boundary, so segments encode as the whole does. A conversation
of any length thus needs bounded memory; its digests grow turn by turn. Null text or role counts as empty, a null turn
comes first, null conv_id is a conversation. Repeated rows are turns of their own, equal turn numbers go by
role and text. No rows, no conversations. Other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spark_schema

OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(r"\\|### |</?turn>")
ESCAPED = re.compile(r"\\(\\|### |</?turn>|n)")
SCAN = re.compile(r"\\(?:\\|### |</?turn>|n)|(### )|(</turn>)")
SEGMENT = 1 << 20


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> str:
    """(role, text) pairs as one string."""
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, int, int]]:
    """Role, and where its text begins and ends in the rendered string, of each turn."""
    out, opened = [], None
    for m in SCAN.finditer(rendered):
        if m[1]:
            opened = m.end()
        elif m[2] and opened is not None:
            line = rendered.index("\n", opened)
            out.append((unescape(rendered[opened:line]), line + 1, m.start()))
            opened = None
    return out


def intersect(tokens: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Parts of token spans (n x 2, sorted) inside turn spans (m x 2, sorted, disjoint): rows (token, start, end)."""
    if not len(tokens) or not len(turns):
        return np.zeros((0, 3), np.int64)
    low = np.searchsorted(turns[:, 1], tokens[:, 0], "right")  # the first turn that ends behind the token's start
    high = np.searchsorted(turns[:, 0], tokens[:, 1], "left")  # the first that begins at its end or later
    n = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(tokens)), n)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    part = np.stack([token, np.maximum(tokens[token, 0], turns[turn, 0]), np.minimum(tokens[token, 1], turns[turn, 1])], 1)
    return part[part[:, 1] < part[:, 2]]


def union(parts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of sorted (start, end) rows."""
    out: list[list[int]] = []
    for s, e in parts.tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def encode_with_offsets(path: str, rendered: str) -> tuple[list[int], np.ndarray]:
    """Ids, and the code points each token covers."""
    found = _library(path).encode(rendered, add_special_tokens=False)
    return found.ids, np.array(found.offsets, np.int64).reshape(-1, 2)


class _Conversation:
    def __init__(self, key):
        self.key, self.turns, self.loss, self.chars, self.tokens, self.masked = key, 0, 0, 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[tuple[str, str]] = []
        self.size = 0

    def add(self, role: str, text: str, path: str, loss_role: str) -> None:
        self.waiting.append((role, text))
        self.size += len(role) + len(text)
        if self.size >= SEGMENT:
            self.flush(path, loss_role)

    def flush(self, path: str, loss_role: str) -> None:
        if not self.waiting:
            return
        rendered = render(self.waiting)
        self.waiting, self.size = [], 0
        turns = parse(rendered)
        ids, offsets = encode_with_offsets(path, rendered)
        spans = np.array([(s, e) for role, s, e in turns if role == loss_role and s < e], np.int64).reshape(-1, 2)
        parts = intersect(offsets, spans)
        for role, s, e in turns:
            self.turn_hash.update(f"{role}\n{unescape(rendered[s:e])}\n".encode())
        # a mask never reaches over a turn's end, so that each interval holds whole escapes
        for s, e in union(parts[:, 1:]):
            text = unescape(rendered[s:e])
            self.loss += len(text)
            self.loss_hash.update(text.encode())
        self.turns += len(turns)
        self.chars += len(rendered)
        self.tokens += len(ids)
        self.masked += len(np.unique(parts[:, 0]))

    def row(self) -> tuple:
        return self.key, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.tokens, self.masked


def format_turns(df: DataFrame, path: str, loss_role: str = "assistant") -> DataFrame:
    """Per conversation of df (conv_id, turn, role, text): its digests, n_tokens and n_loss_tokens."""
    bound_batches(df.sparkSession)
    out = spark_schema("conv_id bigint,n_turns long,turns_sha256 string,loss_chars long,loss_sha256 string,formatted_chars long,n_tokens long,n_loss_tokens long")
    rows = df.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        now, ready = None, []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now.key != key:
                    if now:
                        now.flush(path, loss_role)
                        ready.append(now.row())
                    now = _Conversation(key)
                now.add(role, text, path, loss_role)
            if len(ready) >= 1000:
                yield emit()
                ready = []
        if now:
            now.flush(path, loss_role)
            ready.append(now.row())
        if ready:
            yield emit()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, out)


def formatted(df: DataFrame, max_chars: int = SEGMENT) -> DataFrame:
    """conv_id, formatted: the rendered string, in parts of whole turns (part counts from 0) of about max_chars."""
    bound_batches(df.sparkSession)
    out = spark_schema("conv_id bigint,part int,formatted string")
    rows = df.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        row = lambda key, part, text: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, part, text), schema, strict=True)], schema=schema)
        now, part, held = "", 0, None
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held is not None and (held[0] != key or len(now) >= max_chars):
                    yield row(held[0], part, now)
                    part, now = (part + 1 if held[0] == key else 0), ""
                held = (key,)
                now += render([(role, text)])
        if held is not None:
            yield row(held[0], part, now)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, out)
