"""Personal data: patterns with validation, and a skip-chain conditional random field for mentions they miss.

Base spans (email, ip, card, phone) come from anchored, linear-time patterns and checks. The field works on a document's
candidate tokens: white-space tokens with a digit or an at sign, and tokens equal to the name part of an email. All other
tokens are no personal data by the model's definition, so chains run between neighbouring candidates alone. A token's own
potentials come from its shape and from a base span on it; chain edges join neighbours; skip edges join a token to the
previous similar one of the document, however distant (same last digits, address or name; shorter numbers where a card or
phone number touches an equal one; several tokens whose digits together end as those of a number of several tokens). Each similar group is a path of
such edges, so edges grow with tokens. Loopy sum-product messages with damping give marginals; runs of candidates with
the same label and a high marginal become added spans x_email, x_ip, x_card, x_phone, unless they touch a base span.

The weights are learned here by pseudo-likelihood in numpy, on passages of SAMPLE_CHARS characters of about SAMPLE_ROWS
rows of the table that have a digit or an at sign (the bounds are arguments of train()), with half of the base hits hidden
so that skip edges must carry labels.

Null text counts as empty; an empty text has no span. Repeated rows get equal spans. Spans that start
together are listed by kind; of equally likely labels the first listed wins. Offsets are code points. Without a
base span in the sample nothing is learned and only base spans are given. Very long texts are taken whole, alone in their
batch. An empty table gives an empty result. Other columns are not read and may have any name; see common.carried() for
those handed on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_texts

# The kinds, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ADDED = tuple(f"x_{k}" for k in KINDS)
ORDER = {k: i for i, k in enumerate((*KINDS, *ADDED))}

NAME_RUN = re.compile(rb"[A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
TOKEN = re.compile(rb"[^ \t-\r]++")
EDGE = b"\"'()[]{}<>,;:!?.*#%&$|"
_NAME = np.zeros(256, bool)
_NAME[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 4_000
SURE = 0.9
#: Added to the score of a token's base label and taken from all its scores.
CERTAIN = 30.0
#: Rounds of messages beyond two for each of a document's edges, damping, and the change below which they rest.
ROUNDS, DAMP, SETTLED = 30, 0.3, 1e-4
#: Digits at the end that tell a number from others.
LAST_DIGITS = 7


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = (c - 48) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: bytes) -> list[tuple[int, int]]:
    """At each at sign: the longest name run before it, not reaching into the last match, and a domain behind it."""
    out, last, at = [], 0, text.find(b"@")
    while at >= 0:
        if at >= last:
            start = at
            while start > last and _NAME[text[start - 1]]:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                last = m.end()
                out.append((start, last))
            else:
                last = max(last, at)  # nothing before an at sign without a match can begin a later one
        at = text.find(b"@", at + 1)
    return out


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Spans of the four kinds in bytes, by start and then kind."""
    out = [("email", s, e) for s, e in emails(text)] if b"@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip(b"0")) <= 3 and int(x[-4:]) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].translate(None, b" -")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if b"+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def similar_key(token: bytes) -> bytes | None:
    """What similar tokens share: the name of an address, dotted numbers, or the last seven digits."""
    if b"@" in token:
        name = token.split(b"@", 1)[0].lower()
        return b"n" + name if len(name) >= 4 else None
    if m := IP.search(token):
        return b"i" + m[0]
    digits = digits_in(token)
    return b"d" + digits[-LAST_DIGITS:] if len(digits) >= LAST_DIGITS and len(digits) * 2 > len(token) else None


def digits_in(token: bytes) -> bytes:
    return bytes(c for c in token if 48 <= c <= 57)


def touched_keys(text: bytes, tokens: list[tuple[int, int]], found: list[tuple[str, int, int]]) -> tuple[set[bytes], set[bytes]]:
    """Digits of the tokens that base spans of cards and phones touch, and the last digits of such spans of several tokens."""
    touched, whole, ends = set(), set(), [e for _, e in tokens]
    for kind, s, e in found:
        if kind in ("card", "phone"):
            first = bisect_right(ends, s)
            over = [text[a:b] for a, b in takewhile(lambda x: x[0] < e, map(tokens.__getitem__, range(first, len(tokens))))]
            touched.update(digits_in(t) for t in over)
            if len(over) > 1:
                whole.add(digits_in(text[s:e])[-LAST_DIGITS:])
    touched.discard(b"")
    return touched, whole


def variant(token: bytes) -> bytes:
    """How a repeated mention may be written: the name of an address alone, or digits without what parts them."""
    token = token.strip(EDGE)
    return token.split(b"@", 1)[0] if b"@" in token else bytes(c for c in token if 48 <= c <= 57)


FEATURES = 22


def features(token: bytes, before: bytes, after: bytes) -> np.ndarray:
    """Shape of a token and of its neighbours in the text."""
    digits = sum(48 <= c <= 57 for c in token)
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in token)
    dots = token.count(b".")
    x = np.zeros(FEATURES, np.float32)
    x[[0, 1 + min(5, digits // 3), 7 + min(3, letters // 3), 11 + min(3, dots)]] = 1
    x[15] = b"@" in token
    x[16] = token[:1] == b"+"
    x[17] = token[:1] == b"(" and token[-1:] == b")"
    x[18] = b"-" in token[1:]
    x[19] = before[:1] == b"+"
    x[20] = before[-1:] in (b"=", b":")
    x[21] = bool(re.search(rb"[0-9]", after[:1]))
    return x


class Graph:
    """Candidate tokens of some texts: where they are, their features, base labels, chain and skip edges."""

    def __init__(self, texts: list[bytes], spans: list[list[tuple[str, int, int]]], variants: bool = False):
        self.varied: list[np.ndarray] = []  # of base hits, for training
        self.doc, self.start, self.end, rows, self.base = [], [], [], [], []
        chain, skip = [], set()
        for d, (text, found) in enumerate(zip(texts, spans, strict=True)):
            if not DIGIT.search(text) and b"@" not in text:
                continue
            tokens = [m.span() for m in TOKEN.finditer(text)]
            names = {text[s:e].split(b"@", 1)[0].lower() for k, s, e in found if k == "email"}
            touched, whole = touched_keys(text, tokens, found)
            run: list[tuple[int, int]] = []  # candidates without a break and the digits of each
            digits_of_run = b""
            at, last, seen = 0, -2, {}
            for i, (s, e) in enumerate(tokens):
                token = text[s:e]
                plain = token.strip(EDGE).lower()
                name = plain in names
                if not (name or b"@" in token or DIGIT.search(token)):
                    continue
                while at < len(found) and found[at][2] <= s:
                    at += 1
                over, j = None, at
                while over is None and j < len(found) and found[j][1] < e:
                    over, j = found[j][0] if s < found[j][2] else None, j + 1
                me = len(self.doc)
                self.doc.append(d)
                self.start.append(s + len(token) - len(token.lstrip(EDGE)))
                self.end.append(s + len(token.rstrip(EDGE)))
                self.base.append(LABELS.index(over) if over else 0)
                rows.append(features(token, text[slice(*tokens[i - 1])] if i else b"", text[slice(*tokens[i + 1])] if i + 1 < len(tokens) else b""))
                if variants and over:
                    self.varied.append(features(variant(token), b"", b""))
                if last == i - 1:
                    chain.append((me - 1, me))
                else:
                    run, digits_of_run = [], b""
                last = i
                digits = digits_in(plain)
                address = plain.split(b"@", 1)[0]
                keys = {b"n" + address if name or b"@" in plain and address in names else similar_key(plain) or (b"d" + digits if digits in touched and len(digits) * 2 > len(plain) else None)}
                keys.discard(None)
                for key in keys:
                    if key in seen and seen[key] != me:
                        skip.add((seen[key], me))
                    seen[key] = me
                if not digits or len(digits) * 2 <= len(plain):
                    run, digits_of_run = [], b""
                    continue
                run = [*run, (me, len(digits))][-LAST_DIGITS:]
                digits_of_run = (digits_of_run + digits)[-LAST_DIGITS:]
                if digits_of_run in whole and len(digits) < LAST_DIGITS:
                    # a mention in several tokens: all that hold its last digits join the mention that was seen before
                    key, left, parts = b"d" + digits_of_run, LAST_DIGITS, []
                    while left > 0:
                        parts.append(run[-1 - len(parts)][0])
                        left -= run[-len(parts)][1]
                    skip.update((seen[key], part) for part in parts if key in seen and seen[key] < part)
                    seen[key] = me
        self.n = len(self.doc)
        self.x = np.array(rows, np.float32).reshape(-1, FEATURES)
        self.base = np.array(self.base, np.int64)
        self.chain, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, sorted(skip)))


class SkipChainCrf:
    """Weights: w (features and base label -> label), chain and skip (label x label)."""

    def __init__(self):
        k = len(LABELS)
        self.w = np.zeros((FEATURES + k, k))
        self.chain, self.skip = np.zeros((k, k)), np.zeros((k, k))

    @staticmethod
    def inputs(graph: Graph, hidden: np.ndarray | None = None) -> np.ndarray:
        seen = np.eye(len(LABELS))[graph.base]
        seen[:, 0] = 0
        if hidden is not None:
            seen[hidden] = 0
        return np.concatenate([graph.x, seen], axis=1)

    def fit(self, graph: Graph, steps: int = 300, rate: float = 0.5, seed: int = 0) -> SkipChainCrf:
        """Pseudo-likelihood: each label given its neighbours', with half of the base hits hidden. graph: with variants."""
        rng = np.random.default_rng(seed)
        k = len(LABELS)
        y = np.eye(k)[graph.base]
        positive = graph.base > 0
        # copies of every hit: its base label hidden, joined by a skip edge to the hit itself, as a repeated mention would be
        hits = np.flatnonzero(positive)
        hidden = rng.random(graph.n) < 0.5
        shapes = np.concatenate([graph.x[hits], np.array(graph.varied, np.float32).reshape(-1, FEATURES)])
        hits = np.concatenate([hits, hits])
        x = np.concatenate([self.inputs(graph, hidden), np.concatenate([shapes, np.zeros((len(hits), k))], axis=1)])
        target = np.concatenate([y, y[hits]])
        left, right = np.zeros((2, len(x), k))
        np.add.at(left, graph.chain[:, 1], y[graph.chain[:, 0]])
        np.add.at(right, graph.chain[:, 0], y[graph.chain[:, 1]])
        far = np.zeros((len(x), k))
        for a, b in ((0, 1), (1, 0)):
            np.add.at(far, graph.skip[:, a], y[graph.skip[:, b]])
        far[graph.n :] = y[hits]
        # a shape alone is no evidence: hidden hits without a neighbour count as none
        alone = np.append(hidden & positive, np.zeros(len(hits), bool)) & (left.sum(1) + right.sum(1) + far.sum(1) == 0)
        target[alone] = y[0] * 0
        target[alone, 0] = 1
        # a token without a base span that is similar to a hit may be a mention that the patterns miss: it is no example of none
        told = np.ones((len(x), 1))
        for a, b in ((0, 1), (1, 0)):
            told[graph.skip[:, a][positive[graph.skip[:, b]] & ~positive[graph.skip[:, a]]]] = 0
        velocity = [np.zeros_like(p) for p in (self.w, self.chain, self.skip)]
        for step in range(steps):
            scores = x @ self.w + left @ self.chain + right @ self.chain.T + far @ self.skip
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            scores /= scores.sum(axis=1, keepdims=True)
            error = told * (target - scores) / len(x)
            skip = far.T @ error
            grads = (x.T @ error - 1e-5 * self.w, left.T @ error + (right.T @ error).T - 1e-5 * self.chain, (skip + skip.T) / 2 - 1e-5 * self.skip)
            for p, v, g in zip((self.w, self.chain, self.skip), velocity, grads, strict=True):
                v *= 0.9
                v += rate * g * len(LABELS)
                p += v
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of the candidates by loopy sum-product messages. Base spans are given, so their tokens are
        clamped to their label, as neighbours were in training."""
        k = len(LABELS)
        own = self.inputs(graph) @ self.w
        own[graph.base > 0] -= CERTAIN
        own[np.flatnonzero(graph.base), graph.base[graph.base > 0]] += CERTAIN
        edges = np.concatenate([graph.chain, graph.skip])
        if not len(edges):
            p = np.exp(own - own.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), k, k)), np.broadcast_to(self.skip, (len(graph.skip), k, k))])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        goal = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        m = np.zeros((len(source), k))
        twin = np.roll(np.arange(len(source)), len(edges))
        doc = np.asarray(graph.doc)[source]
        # a document's messages rest when they have settled: what else is in the batch doesn't show in its result. They may
        # travel along all its edges; damped, an edge takes less than two rounds
        live, longest = np.ones(len(source), bool), ROUNDS + np.bincount(doc)
        for step in range(int(longest.max())):
            belief = own.copy()
            np.add.at(belief, goal, m)
            at = np.flatnonzero(live)
            sent = belief[source[at]] - m[twin[at]]
            sent = np.exp(sent - sent.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", sent, pair[at]) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            change = np.zeros(int(doc.max()) + 1)
            np.maximum.at(change, doc[at], np.abs(new - m[at]).max(axis=1))
            m[at] = DAMP * m[at] + (1 - DAMP) * new
            live = (change[doc] >= SETTLED) & (longest[doc] > step + 1)
            if not live.any():
                break
        belief = own.copy()
        np.add.at(belief, goal, m)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def added_spans(texts: list[bytes], spans: list[list[tuple[str, int, int]]], model: SkipChainCrf | None) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds beside the base spans, in bytes."""
    out: list[list] = [[] for _ in texts]
    if model is None:
        return out
    graph = Graph(texts, spans)
    if not graph.n:
        return out
    p = model.marginals(graph)
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    next_to = {int(b): int(a) for a, b in graph.chain}
    for i in np.flatnonzero((label > 0) & (graph.base == 0)).tolist():
        d, kind = graph.doc[i], ADDED[label[i] - 1]
        before = next_to.get(i)
        if graph.start[i] >= graph.end[i]:
            continue
        if before is not None and label[before] == label[i] and graph.base[before] == 0 and out[d] and out[d][-1][2] == graph.end[before]:
            out[d][-1] = (kind, out[d][-1][1], graph.end[i])
        else:
            out[d].append((kind, graph.start[i], graph.end[i]))
    return [[x for x in found if not any(x[1] < e and s < x[2] for _, s, e in base)] if found else found for found, base in zip(out, spans, strict=True)]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> SkipChainCrf | None:
    """A field learned from about `rows` rows with a digit or an at sign, those whose hash of the id is low enough, of each
    a passage of `chars` characters at a hashed place."""
    key, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    telling = df.select(key.alias("key"), text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = telling.count()
    spread = F.shiftrightunsigned(F.xxhash64("key", F.lit(10)), 11) / F.lit(float(1 << 53))
    at = F.pmod(F.xxhash64("key", F.lit(11)), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    sample = telling.where(spread < min(1.0, rows / max(n, 1))).select("key", F.substring("text", (at + 1).cast("int"), F.lit(chars)).alias("text"))
    texts = [r.text.encode() for r in sorted(sample.collect(), key=lambda r: (r.key or "", r.text))]
    spans = [base_spans(t) for t in texts]
    if not any(spans):
        return None
    return SkipChainCrf().fit(Graph(texts, spans, variants=True))


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(at[s]), int(at[e])) for k, s, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(texts: list[bytes], model: SkipChainCrf | None) -> list[tuple[list, list]]:
    """Base and all spans of each text, in code points."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, model)
    return [(in_code_points(t, b), in_code_points(t, sorted(b + a, key=lambda x: (x[1], ORDER[x[0]])))) for t, b, a in zip(texts, base, more, strict=True)]


def find_personal_data(df: DataFrame, model: SkipChainCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[bytes]) -> list:
        each = scan(texts, shared.value)
        counts = [[sum(x == k for x, *_ in base) for base, _ in each] for k in KINDS]
        return [*counts, [len(a) - len(b) for b, a in each], [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in each], [joined(a) for _, a in each]]

    return map_texts(df, kernel, "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string", id_col, text_col, as_bytes=True)


def without_personal_data(df: DataFrame, model: SkipChainCrf | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, clean (the text with every span replaced by its kind; null stays null) and the columns of `carry`."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kernel = lambda texts: [[redacted(t.decode(), joined(every)) for t, (_, every) in zip(texts, scan(texts, shared.value), strict=True)]]
    found = map_texts(df, kernel, "clean string", as_bytes=True, carry=("text", *carry))
    clean = F.when(F.col("text").isNotNull(), F.col("clean")).alias("clean")
    return found.select("doc_id", clean, *(f"`{c}`" for c in carried(carry, ("doc_id", "clean")).values()))


def redacted(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, s, e in sorted((tuple(x.split(":")) for x in spans.split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
        s, e = int(s), int(e)
        if s >= last:
            out += [text[last:s], f"[{kind.removeprefix('x_').upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])
