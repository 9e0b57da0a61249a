import hashlib
import random

import numpy as np
from spanloom.llm import chat_format as C
from spanloom.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_hostile_texts():
    rng = random.Random(0)
    parts = ["\\", "### ", "</turn>", "<turn>", "\n", "n", "Assistant", ":", "é😀", " ", "<", "/turn>", "#"]
    for _ in range(2000):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        text = C.render(turns)
        assert [(role, C.unescape(text[s:e])) for role, s, e in C.parse(text)] == turns


def test_intersections_against_loops():
    rng = np.random.default_rng(0)
    for _ in range(100):
        cuts = np.sort(rng.integers(0, 60, 12))
        tokens = np.stack([cuts[:-1], cuts[1:]], 1)
        turns = np.sort(rng.choice(60, 6, replace=False)).reshape(-1, 2)
        brute = [(i, max(a, c), min(b, d)) for i, (a, b) in enumerate(tokens.tolist()) for c, d in turns.tolist() if max(a, c) < min(b, d)]
        assert C.intersect(tokens, turns).tolist() == [list(x) for x in brute]


def check(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = [(1, 1, "assistant", "fine, thanks"), (1, 0, "user", "how are you?"), (1, 2, "assistant", "é😀</turn>"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", ""), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (None, None, "assistant", "nobody"), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    rows += [(9, i, "assistant" if i % 2 else "user", "word " * 50) for i in range(60)]
    got = {r.conv_id: r for r in C.format_turns(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    for key in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[key]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and g.loss_sha256 == sha(loss)
        assert g.formatted_chars == len(C.render(turns))
    text = {}
    for r in sorted(C.formatted(spark.createDataFrame(rows, SCHEMA), 300).collect(), key=lambda r: r.part):
        text[r.conv_id] = text.get(r.conv_id, "") + r.formatted
    assert all(len(text[k]) == got[k].formatted_chars for k in got)
    return got


def test_conversations(spark, monkeypatch):
    assert check(spark, monkeypatch, 1 << 20) == check(spark, monkeypatch, 64)  # segments change nothing, token counts included


def test_empty(spark):
    assert C.format_turns(spark.createDataFrame([], SCHEMA), PATH).count() == 0
