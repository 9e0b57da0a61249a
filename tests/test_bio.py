"""Tags of random notes against one span after another."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import spans as S
from spanloom.operators import tags, tokens


def plain(tokens, spans):
    out = {(n, o): "O" for n, o, *_ in tokens}
    for n, _, s, e, cls in sorted(spans, key=lambda x: (str(x[0]), x[1])):
        hit = sorted((b, o) for m, o, b, z, _ in tokens if m == n and max(b, s) < min(z, e))
        for i, (_, o) in enumerate(hit):
            out[n, o] = ("I-" if i else "B-") + cls
    return out


def test_random_notes(spark):
    rng = random.Random(9)
    tokens, spans = [], []
    for n in ["n1", "n2", "n3", *(f"x{i}" for i in range(30))]:
        at = 0
        for o in range(rng.randint(0, 40)):
            at += rng.randint(0, 3)
            size = rng.randint(1, 6)
            tokens.append((n, o, at, at + size, "t"))
            at += size
        spans += [(n, i, s, s + rng.randint(1, 25), rng.choice("ab")) for i, s in enumerate(rng.randint(0, 120) for _ in range(rng.randint(0, 9)))]
    spans.append(("no tokens", 0, 1, 5, "a"))
    t = spark.createDataFrame(tokens, "note_id string, ord int, start int, end int, tok string")
    s = spark.createDataFrame(spans, "note_id string, ord int, start int, end int, cls string")
    got = tags.bio_encode(t, s).collect()
    assert len(got) == len(tokens) and {(r.note_id, r.ord): r.tag for r in got} == plain(tokens, spans)
    assert all(r.tok == "t" for r in got)
    assert {r.tag for r in tags.bio_encode(t, s.where("false")).collect()} == {"O"}
    assert tags.bio_encode(t.where("false"), s).count() == 0


def test_decoding_of_noted_texts(spark):
    """Tags and mentions from the texts and their arrays of spans, as from rows of tokens; no shuffle."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab ,é-"), rng.integers(0, 60))) for _ in range(80)] + ["", None]
    spans = [[(int(s), int(s + rng.integers(0, 12)), o, "xy"[rng.integers(2)]) for o, s in enumerate(rng.integers(0, 60, rng.integers(0, 9)))] for _ in texts]
    kind = "note_id string, text string, spans array<struct<start: int, end: int, ord: int, cls: string>>"
    noted = spark.createDataFrame([(str(i), t, s if i % 9 else None) for i, (t, s) in enumerate(zip(texts, spans, strict=True))], kind).localCheckpoint()
    flat = noted.select("note_id", F.inline("spans"))
    tagged = tags.bio_encode(tokens.token_table(noted).select("note_id", "ord", "start", "end"), flat).withColumn("conf", (F.col("start") % 7 + 1) / 8.0).localCheckpoint()
    for want, conf in ((tags.bio_decode(tagged), None), (tags.bio_decode_merging(tagged), lambda start, end: (start % 7 + 1) / 8.0)):
        got = tags.decode_noted(noted, ["x", "y"], conf)
        rows = lambda df: sorted(tuple(r)[:4] + tuple(round(x, 9) for x in r[4:]) for r in df.collect())
        assert rows(got) == rows(want) and got.count() > 50
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    named = S.noted_surfaces(noted)
    assert all(r.surface == (None if texts[int(r.note_id)] is None else texts[int(r.note_id)][r.start : r.end]) for r in named.collect()) and named.count() == flat.count()
