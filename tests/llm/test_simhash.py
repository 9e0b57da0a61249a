import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from spanloom.llm import components as C
from spanloom.llm import simhash_dedup as S
from spanloom.llm.components import connected_components


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        before = label[:]
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


@pytest.mark.parametrize("size", [2, 3, 4])
def test_covering(size):
    sets = [set(x) for x in S.covering(size)]
    assert len(sets) == {2: 7, 3: 20, 4: 70}[size]
    assert all(any(x <= set(four) for x in sets) for four in combinations(range(8), 4))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(250, 300)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = components(300, edges)
    assert all(got.get(i, i) == label[i] for i in range(300))


@pytest.mark.parametrize(("block", "size"), [(4096, 2), (8, 2), (4096, 3), (8, 3), (4096, 4)])
def test_links_lose_none(spark, monkeypatch, block, size):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(2)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    at = {f: i for i, f in enumerate(signed)}
    found = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), size=size)
    edges = [(at[r.u], at[r.v]) for r in found.collect()]
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert set(map(frozenset, edges)) <= set(map(frozenset, true))
    assert components(len(fps), edges) == components(len(fps), true)


def test_documents_against_brute_force(spark, prose):
    rng = random.Random(3)
    docs = [(i, t) for i, t, *_ in prose[:60]]
    for i in range(60):
        words = docs[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((100 + i, " ".join(words)))
    docs += [(300, docs[0][1].upper()), (301, None), (302, ""), (303, " \n")]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in docs]
    label = components(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for k, (i, _) in enumerate(docs):
        assert got[i].fingerprint == f"{fps[k]:016x}"
        assert got[i].component_id == docs[label[k]][0]
    assert got[301].component_id == got[303].component_id == 301


def test_edges(edge_docs, no_docs):
    got = S.near_duplicates(edge_docs).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert S.near_duplicates(no_docs).count() == 0
    kept = [r.doc_id for r in S.one_of_each(edge_docs).collect()]
    assert kept.count(4) == 1 and 5 not in kept and None in kept and kept.count(1) == 1


def test_repeated_ids_are_decided_per_row(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(3, a), (5, a), (5, b), (7, b), (7, b), (8, None), (8, None)]
    got = sorted((r.doc_id, r.text) for r in S.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.text)
    assert got == [(3, a), (5, b)]


def test_one_fingerprint_in_most_rows(spark, monkeypatch, prose):
    """Hot fingerprints and hubs go by broadcast, with the same result."""
    monkeypatch.setattr(C, "HOT_ROWS", 20)
    monkeypatch.setattr(C, "HOT_SHARE", 4)
    docs = [(i, prose[3][1]) for i in range(1000, 1300)] + [(i, t) for i, t, *_ in prose]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == 460 and all(got[i] == got[3] for i in range(1000, 1300)) and got[3] == min(i for i in got if got[i] == got[3])
    star = [(0, i) for i in range(1, 200)] + [(500, 501)]
    found = {r.u: r.root for r in C.connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 200)} | {501: 500}


def test_shingles_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    want = np.concatenate(list(S.shingle_hashes(text, 5)))
    monkeypatch.setattr(S, "PIECE", 50)
    assert (np.concatenate(list(S.shingle_hashes(text, 5))) == want).all()
    assert len(np.concatenate(list(S.shingle_hashes(b"a " * 90, 1)))) == 90


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from spanloom.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_path(session)
    session.sparkContext.master = "local[4]"
    assert common.shared_path(session)
