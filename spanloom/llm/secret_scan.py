"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions at the hits, embedded checksum validation.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds where a keyword stands; the expression of a kind
is tried only there, anchored. Taking the hits from left to right and skipping those inside the last match gives the
leftmost non-overlapping matches, as every match begins with a keyword. Runs of hexadecimal digits have no keyword; their
anchor is a probe of every 16th byte, since a run of 16 or more covers one of them. Tokens that carry a checksum
(prefix, 30 characters, CRC-32 of these in 6 base-62 digits) are added only where it holds.

Null text counts as empty; an empty text has no span. Repeated rows each get their result. Offsets are code points. Spans
of a kind don't overlap, so ties are between kinds alone and go by their order. Very long texts are scanned whole. An empty
table gives an empty result. Other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# The keywords of each kind, and the order of kinds at equal starts.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORDS = ("akia",)
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KINDS = ("assign", "access", "hex", "checked")

ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
HEX_MIN = 16
HEX_RUN = re.compile(rb"[0-9a-f]+")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ACCESS_WORDS), ("checked", CHECKED_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: bytes) -> str:
    """CRC-32 of body in six base-62 digits."""
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits


def _anchored(text: bytes, starts: list[int], pattern: re.Pattern, holds) -> list[tuple[int, int]]:
    spans, last = [], 0
    for start in starts:
        if start >= last and (m := pattern.match(text, start)):
            last = m.end()
            if holds(m):
                spans.append((start, last))
    return spans


def hex_runs(text: bytes) -> list[tuple[int, int]]:
    """Maximal runs of [0-9a-f] with HEX_MIN or more."""
    if len(text) < HEX_MIN:
        return []
    probes = np.flatnonzero(_HEX[np.frombuffer(text, np.uint8)[HEX_MIN - 1 :: HEX_MIN]]) * HEX_MIN + HEX_MIN - 1
    spans, last = [], 0
    for p in probes.tolist():
        if p < last:
            continue
        start = p
        while start > last and _HEX[text[start - 1]]:
            start -= 1
        last = HEX_RUN.match(text, start).end()
        if last - start >= HEX_MIN:
            spans.append((start, last))
    return spans


def byte_spans(text: bytes) -> list[tuple[str, int, int]]:
    """All spans of a text in bytes, by start and then kind."""
    hits: dict[str, list[int]] = {k: [] for k in KINDS}
    for end, (kind, n) in automaton().iter(text.lower().decode("latin-1")):
        hits[kind].append(end - n + 1)
    found = {
        "assign": _anchored(text, sorted(hits["assign"]), ASSIGN, lambda m: len(m[2]) >= 12),
        "access": _anchored(text, sorted(hits["access"]), ACCESS, lambda m: len(m[0]) >= 18),
        "hex": hex_runs(text),
        "checked": _anchored(text, sorted(hits["checked"]), CHECKED, lambda m: checksum(m[1]).encode() == m[2]),
    }
    return sorted(((k, *span) for k in KINDS for span in found[k]), key=lambda x: (x[1], KINDS.index(x[0])))


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(at[s]), int(at[e])) for k, s, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _kernel(texts: list[bytes]) -> list:
    each = [in_code_points(t, byte_spans(t)) for t in texts]
    counts = [[sum(k == kind for k, *_ in spans) for spans in each] for kind in KINDS]
    base = [hashlib.sha256(joined([x for x in spans if x[0] != "checked"]).encode()).hexdigest() for spans in each]
    return [*counts, base, [joined(spans) for spans in each]]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans (kind:start:end, comma-joined) of each row."""
    return map_texts(df, _kernel, "n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string", id_col, text_col, as_bytes=True)
