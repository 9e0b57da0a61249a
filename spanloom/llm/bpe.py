"""BPE encoding and decoding by batched numpy merge rounds.

Texts are normalised and cut into words as the tokenizer file says. The symbols of all words of a batch that are not known
yet stand in one flat array. A round finds, for each word, its adjacent pair of lowest rank (by binary search over the
sorted pair keys) and merges all its non-overlapping occurrences from the left; words without a pair leave. Results are
kept per white-space piece in a bounded table of the process; when it is full it is emptied, which changes no result.

The tokenizer file is a parameter, read by the workers from the same path (a file of an installed package). Supported are
files with the normaliser NFC, white space to a space, lower case; words by the pattern below; byte-level symbols with a
word-end suffix; no decoder, which joins token strings by spaces. Others raise ValueError.

Null text counts as empty and has no tokens. Strings of special tokens in a text are their tokens, as in the library.
Equal ranks don't occur; of equal pairs the leftmost merge first. Repeated rows get equal results. Very long texts are
encoded whole, alone in their slice. An empty table gives an empty result. Other columns are not read and may have any name;
see common.carried() for those handed on.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

# The patterns of the tokenizer's normaliser and word cutter.
SPACE = r"\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space as Unicode has it; str.split() also takes the four separators 1C to 1F.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
WHITE = "".join(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Texts with other characters than these (whose class has been the same in all recent versions of Unicode) are normalised
#: and cut into words by the library itself; merging is ours for all.
COMMON = [(0, 0x557), (0x590, 0x74F), (0x900, 0xC5B), (0x1E00, 0x208E), (0x20A0, 0x2BFF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF)]
#: Pieces whose encoding a worker keeps.
TABLE_ROWS = 240_000
#: Bytes of text encoded at once. Small enough that a slice's new pieces seldom push the table over its bound.
SLICE_BYTES = 4 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBpe:
    """The tokenizer of a file; encode() gives ids, decode() gives text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cut = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or cut[0]["pattern"]["Regex"] != WORDS or spec["decoder"] or spec["normalizer"]["normalizers"][1]["pattern"]["Regex"] != SPACE:
            raise ValueError(f"{path}: this kind of tokenizer is not supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        self.n = len(vocab) + len(self.special)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], np.int64)
        keys = pairs[:, 0] * self.n + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, pairs[:, 2]
        self.cut = regex.compile(WORDS)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.spaces = regex.compile(f"[{WHITE}]+")
        self.rare = regex.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in COMMON).replace("\0", "\\x00") + "]")
        self.path, self.library = path, None
        self.table: dict[str, tuple[bytes, bytes]] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search over the sorted pair keys; the number of ranks where there is none."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty words one after another, and where each word's begin and end."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        last = np.cumsum(sizes) - 1
        ids[last] = self.final[flat[last]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        none = len(self.ranks)
        rank = np.append(self.ranks_of(ids[:-1], ids[1:]), none)
        rank[last] = none
        done_ids, done_word = [], []
        while len(ids):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(ids)))
            least = np.minimum.reduceat(rank, start)
            if (least == none).any():
                over = np.repeat(least == none, size)
                done_ids.append(ids[over])
                done_word.append(word[over])
                live = ~over
                ids, word, rank = ids[live], word[live], rank[live]
                size, least = size[least != none], least[least != none]
                if not len(ids):
                    break
            # of hits in a row (a pair of equal symbols) every second one counts, from the left
            index = np.flatnonzero(rank == np.repeat(least, size))
            run = np.append(True, np.diff(index) > 1)
            first = index[run][np.cumsum(run) - 1]
            index = index[(index - first) % 2 == 0]
            ids[index] = self.made[rank[index]]
            keep = np.ones(len(ids), bool)
            keep[index + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            # only pairs with a merged symbol are new
            new = index - np.arange(len(index))
            rank[new] = none
            new = np.unique(np.concatenate([new, new[new > 0] - 1]))
            new = new[new + 1 < len(ids)]
            new = new[word[new] == word[new + 1]]
            rank[new] = self.ranks_of(ids[new], ids[new + 1])
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int32)
        ids = (np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64))[np.argsort(word, kind="stable")]
        return ids, np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each piece: its ids as little-endian 32-bit integers, and its token strings joined by spaces."""
        cut = self.cut.findall
        words = {p: (p,) if p.isascii() and p.isalpha() else (p[1:],) if p[0] == " " else cut(p) for p in pieces}
        unique = list({w: None for ws in words.values() for w in ws})
        if not unique:
            return dict.fromkeys(pieces, (b"", b""))
        ids, bound = self.merge([w.encode() for w in unique])
        raw, bound = ids.astype("<u4").tobytes(), bound.tolist()
        names = list(map(self.names.__getitem__, ids.tolist()))
        known = {w: (raw[4 * a : 4 * b], " ".join(names[a:b]).encode()) for w, a, b in zip(unique, bound, bound[1:])}
        return {p: known[ws[0]] if len(ws) == 1 else (b"".join([known[w][0] for w in ws]), b" ".join([known[w][1] for w in ws])) for p, ws in words.items()}

    def cut_by_library(self, text: str) -> list[str]:
        """Words, each marked by a space in front."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [" " + text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The text normalised and split at white space."""
        if not text.isascii():
            if self.rare.search(text):
                return self.cut_by_library(text)
            text = unicodedata.normalize("NFC", text)
        # by character: a capital sigma at a word's end has no form of its own
        text = "σ".join(x.lower() for x in text.split("Σ")) if "Σ" in text else text.lower()
        if any(c in text for c in NOT_SPACE):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text: ids as little-endian 32-bit integers, and its decoded form in UTF-8."""
        rows: list[list] = []
        for text in texts:
            parts = self.at_special.split(text) if "<|" in text else [text]
            rows.append([self.pieces(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        wanted = {p for row in rows for part in row if isinstance(part, list) for p in part}
        new = wanted - self.table.keys()
        known = self.table
        if len(known) + len(new) > TABLE_ROWS:
            known = {p: self.table[p] for p in wanted if p in self.table}
            self.table = known if len(wanted) <= TABLE_ROWS else {}
        learned = self.learn(new)
        known.update(learned)
        if known is not self.table:
            table, self.table = known, {}
        else:
            table = known
        out = []
        for row in rows:
            found = [x for part in row for x in ([table[p] for p in part] if isinstance(part, list) else [(np.uint32(self.special[part]).astype("<u4").tobytes(), part.encode())])]
            out.append((b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as the library does for a file without a decoder."""
        return " ".join(self.names[i] for i in ids)

    def surface(self, ids: list[int]) -> str:
        """The normalised words back, a space behind each, for reading."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        return bytes(b for i in ids for b in [*(back[c] for c in self.names[i].removesuffix("</w>")), *[32] * self.names[i].endswith("</w>")]).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; keep may name ids (array of integers) and decoded (string) too, and
    `carry` columns of df."""
    if not set(keep) <= {"ids", "decoded"}:
        raise ValueError("keep takes ids and decoded")

    def kernel(texts: list[str]) -> list:
        found = tokenizer(path).encode_many(texts)
        out = [[len(a) // 4 for a, _ in found], [hashlib.sha256(a).hexdigest() for a, _ in found], [hashlib.sha256(b).hexdigest() for _, b in found]]
        if "ids" in keep:
            flat = np.frombuffer(b"".join([a for a, _ in found]), "<u4").astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(out[0])), pa.int32()), pa.array(flat)))
        return [*out, [b.decode() for _, b in found]] if "decoded" in keep else out

    more = ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    return map_texts(df, kernel, f"n_tokens long, ids_sha256 string, decoded_sha256 string{more}", id_col, text_col, carry=carry, limit=SLICE_BYTES)
