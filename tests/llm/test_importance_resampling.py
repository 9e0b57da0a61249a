"""The draw against a plain one, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from spanloom.llm import importance_resampling as R


def features(text, runs):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return words, [" ".join(words[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, runs, buckets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, runs)[1])
    t = Counter(bucket(f) for x in target for f in features(x, runs)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        words, found = features(text, runs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    drawn = fit[: len(fit) * share // 100]
    return sorted([(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in fit[len(drawn) :] + [r for r in rows if not r[4]]], key=str)


@pytest.mark.parametrize(("runs", "buckets"), [((1, 1), 10_000), ((1, 2), 50), ((2, 3), 7)])
def test_brute_force(spark, runs, buckets):
    rng = random.Random(3)
    parts = ["the", "Cat", "é", "x1", "SAT", "on-mat", "日本", "a_b", "\n"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs += [docs[5], docs[5], (500, None), (501, ""), (None, "the cat " * 12), (502, "long word " * 30000), (503, "!!"), (7, docs[8][1])]
    target = ["the cat sat", None, "", "日本 x1 x1", "mat"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, weight string")
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), runs, buckets, 30, 8)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, runs, buckets, 30, 8)


def test_ties_share_a_score_and_go_by_id(spark):
    rows = spark.createDataFrame([(i, 30, 1, 0, 7 if i % 2 else 5) for i in range(40)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r["rank"] for r in R.draw(rows, 75).collect()}
    want = [*range(1, 40, 2), *range(0, 20, 2)]
    assert got == {i: None for i in range(40)} | {i: n for n, i in enumerate(want, 1)}


def test_empty_tables(spark, no_docs, edge_docs):
    assert R.resample(no_docs, edge_docs).count() == 0
    got = R.resample(edge_docs, no_docs).collect()
    assert len(got) == edge_docs.count() and all(r["rank"] is None for r in got)


def test_sql(spark, tmp_path):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = c.execute(R.resample_sql()).fetchall()
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    assert sorted(map(tuple, R.resample(read("documents"), read("benchmark")).collect()), key=str) == sorted(want, key=str)
