"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of a window, one from each end; at every position a softmax over both hidden states labels
it. A document's probabilities are the mean over the positions of all its windows, so that every byte of the text counts.
Windows are WINDOW bytes; their states start from zero. The network is trained in numpy by backpropagation through time
with Adam, on a bounded sample whose bounds are arguments of train(): about `rows` labelled rows of each language, and
`most` in all, chosen by a hash of doc_id; of each a passage of `passage` characters at a hashed place, of that `windows`
windows of TRAIN_WINDOW bytes.

Null text, or text without a letter (category L of Unicode), is `und` with score 0; so is every text where no labelled row
exists. Labels are all non-null lang values of rows that may be learned from and have a letter. Repeated rows each get the
result of their text; scores have SCORE_DIGITS digits, and equal ones go to the first label, so that a text's neighbours in
a batch don't show in its result. Very long texts are read whole. An empty table gives an empty result. Other columns are
not read and may have any name; see common.carried() for those handed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
WINDOW, TRAIN_WINDOW = 256, 64
SAMPLE_ROWS, SAMPLE_MOST, PASSAGE, PASSAGES = 400, 40_000, 1024, 3
#: Languages whose counts are sent to all tasks; where there are more, rows are shuffled to them.
SENT = 10_000
SCORE_DIGITS = 5
HIDDEN, STEPS, BATCH, RATE = 8, 220, 192, 0.02
#: Windows that run through the network at once.
TOGETHER = 2048


class ByteGru:
    """Parameters: x (2, 256, 3H) input table, u (2, H, 3H) recurrent, b (2, H) of the candidate, o (2H, C), c (C)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)),
            "b": np.zeros((2, hidden)),
            "o": rng.normal(0, hidden**-0.5, (2 * hidden, len(labels))),
            "c": np.zeros(len(labels)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _gates(self, seen: np.ndarray, h: np.ndarray) -> tuple:
        """seen: (2, B) bytes, h: (2, B, H) -> update, reset, recurrent part of the candidate, candidate."""
        n, p = self.hidden, self.p
        a = np.stack([p["x"][0][seen[0]], p["x"][1][seen[1]]])
        v = h @ p["u"]
        g = 0.5 * np.tanh(0.5 * (a[..., : 2 * n] + v[..., : 2 * n])) + 0.5
        s = v[..., 2 * n :] + p["b"][:, None]
        return g[..., :n], g[..., n:], s, np.tanh(a[..., 2 * n :] + g[..., n:] * s)

    def train_step(self, rows: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for windows (B, T) of bytes and their label numbers."""
        n, p = self.hidden, self.p
        size, steps = rows.shape
        both = np.stack([rows, rows[:, ::-1]]).transpose(2, 0, 1)  # (T, 2, B)
        h = np.zeros((steps + 1, 2, size, n), np.float32)
        kept = []
        for t in range(steps):
            z, r, s, c = self._gates(both[t], h[t])
            h[t + 1] = c + z * (h[t] - c)
            kept.append((z, r, s, c))
        out = np.concatenate([h[1:, 0], h[:0:-1, 1]], axis=-1)  # (T, B, 2H), by position
        scores = out @ p["o"] + p["c"]
        scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
        scores /= scores.sum(axis=-1, keepdims=True)
        loss = -np.log(scores[:, np.arange(size), label] + 1e-9).mean()
        scores[:, np.arange(size), label] -= 1
        scores /= steps * size
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"] = np.einsum("tbh,tbc->hc", out, scores)
        grad["c"] = scores.sum(axis=(0, 1))
        back = scores @ p["o"].T
        dout = np.stack([back[..., :n], back[::-1, :, n:]], axis=1)  # (T, 2, B, H), by step
        dh = np.zeros((2, size, n), np.float32)
        da = np.empty((steps, 2, size, 3 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, s, c = kept[t]
            dh = dh + dout[t]
            dc = dh * (1 - z) * (1 - c * c)
            ds = dc * r
            dr = dc * s * r * (1 - r)
            dz = dh * (h[t] - c) * z * (1 - z)
            dv = np.concatenate([dz, dr, ds], axis=-1)
            da[t] = np.concatenate([dz, dr, dc], axis=-1)
            grad["u"] += h[t].transpose(0, 2, 1) @ dv
            grad["b"] += ds.sum(axis=1)
            dh = dh * z + dv @ p["u"].transpose(0, 2, 1)
        for d in (0, 1):
            np.add.at(grad["x"][d], both[:, d].ravel(), da[:, d].reshape(-1, 3 * n))
        return float(loss), grad

    def fit(self, rows: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> ByteGru:
        """Adam with a falling rate; batches take the labels in equal parts."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in "mv")
        of = [np.flatnonzero(label == i) for i in range(len(self.labels))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(of))) for x in of])
            _, grad = self.train_step(rows[pick], label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def window_sums(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum over its positions of each window's label probabilities. rows: (B, T) bytes, longest first; size: bytes in each."""
        n, p = self.hidden, self.p
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # windows that have a byte t
        place = np.arange(rows.shape[1])
        back = np.take_along_axis(rows, np.clip(size[:, None] - 1 - place, 0, None), axis=1)
        both = np.stack([rows, back]).transpose(2, 0, 1).copy()
        half = p["x"].copy()
        half[..., : 2 * n] *= 0.5  # a sigmoid as a hyperbolic tangent of half its argument
        u = p["u"].copy()
        u[..., : 2 * n] *= 0.5
        b = p["b"][:, None]
        h = np.zeros((2, len(rows), n), np.float32)
        parts = np.empty((2, steps, len(rows), len(self.labels)), np.float32)
        o = p["o"].reshape(2, n, -1)
        for t in range(steps):
            k = live[t]
            v = h[:, :k] @ u
            a = np.stack([half[0][both[t, 0, :k]], half[1][both[t, 1, :k]]])
            g = np.tanh(a[..., : 2 * n] + v[..., : 2 * n])
            g *= 0.5
            g += 0.5
            c = v[..., 2 * n :] + b
            c *= g[..., n:]
            c += a[..., 2 * n :]
            np.tanh(c, out=c)
            now = h[:, :k] - c
            now *= g[..., :n]
            now += c
            h = now
            np.matmul(now, o, out=parts[:, t, :k])
        total = np.zeros((len(rows), len(self.labels)), np.float64)
        for t in range(steps):
            k = live[t]
            scores = parts[0, t, :k] + parts[1, size[:k] - 1 - t, np.arange(k)] + p["c"]
            scores -= scores.max(axis=1, keepdims=True)
            np.exp(scores, out=scores)
            scores /= scores.sum(axis=1, keepdims=True)
            total[:k] += scores
        return total

    def position_labels(self, text: bytes) -> np.ndarray:
        """The label number of every byte of a text."""
        out = []
        for i in range(0, len(text), WINDOW):
            row = np.frombuffer(text[i : i + WINDOW], np.uint8)[None]
            both = np.stack([row, row[:, ::-1]]).transpose(2, 0, 1)
            h = np.zeros((len(both) + 1, 2, 1, self.hidden), np.float32)
            for t in range(len(both)):
                z, _, _, c = self._gates(both[t], h[t])
                h[t + 1] = c + z * (h[t] - c)
            states = np.concatenate([h[1:, 0, 0], h[:0:-1, 1, 0]], axis=-1)
            out.append((states @ self.p["o"] + self.p["c"]).argmax(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; zeros for an empty one."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        base = np.cumsum(lengths) - lengths
        n = -(-lengths // WINDOW)
        doc = np.repeat(np.arange(len(texts)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        size = np.minimum(lengths[doc] - start, WINDOW)
        order = np.argsort(-size, kind="stable")
        total = np.zeros((len(texts), len(self.labels)))
        for i in range(0, len(order), TOGETHER):
            now = order[i : i + TOGETHER]
            rows = flat[(base[doc[now]] + start[now])[:, None] + np.arange(size[now[0]])]
            np.add.at(total, doc[now], self.window_sums(rows, size[now]))
        return total / np.maximum(lengths, 1)[:, None]


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_windows(passages: list[tuple[str, str]], labels: list[str], windows: int = PASSAGES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    rows, label, number = [], [], {name: i for i, name in enumerate(labels)}
    for lang, text in passages:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < TRAIN_WINDOW:
            data = np.tile(data, -(-TRAIN_WINDOW // max(1, len(data))))
        for _ in range(windows):
            at = rng.integers(0, len(data) - TRAIN_WINDOW + 1)
            rows.append(data[at : at + TRAIN_WINDOW])
            label.append(number[lang])
    return np.array(rows), np.array(label)


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
    most: int = SAMPLE_MOST,
    passage: int = PASSAGE,
    windows: int = PASSAGES,
) -> ByteGru | None:
    """A network learned from the rows of df that aren't held out; None where there are none.

    rows: labelled rows of each language, about; most: of all languages together, about; passage: characters taken of a
    row; windows: training windows taken of a passage. The driver holds `most` passages at the most.
    """
    learned = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    learned = learned.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    counts = learned.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    share = F.lit(float(min(rows, max(1, most // languages)))) / F.col("n")
    key = F.col("doc_id").cast("string")
    spread = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 11) / F.lit(float(1 << 53))
    at = F.pmod(F.xxhash64(key, F.lit(2)), F.greatest(F.length("text") - passage + 1, F.lit(1)))
    sample = learned.join(F.broadcast(counts) if languages <= SENT else counts, "lang").where(spread < share)
    found = sample.select("lang", F.substring("text", (at + 1).cast("int"), F.lit(passage)).alias("passage")).collect()
    passages = sorted((r.lang, r.passage) for r in found)
    if not passages:
        return None
    labels = sorted({lang for lang, _ in passages})
    return ByteGru(labels).fit(*training_windows(passages, labels, windows))


def predict(df: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of each row, and the columns of `carry`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[str]) -> list:
        network = shared.value
        known = [i for i, t in enumerate(texts) if network and LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            best = np.round(network.probabilities([texts[i].encode() for i in known]), SCORE_DIGITS)
            for i, row in zip(known, best, strict=True):
                names[i], scores[i] = network.labels[row.argmax()], min(1.0, float(row.max()))
        return [pa.array(names, pa.string()), scores]

    return map_texts(df, kernel, "lang_pred string, score double", id_col, text_col, carry=carry)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on df and predict all of it: doc_id, held_out, lang_pred, score."""
    found = predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
