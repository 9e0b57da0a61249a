import math
from collections import Counter

import pytest
from spanloom.llm import lm_score as L


def brute(texts, order=3, alpha=0.4):
    docs = [((t or "").translate({c: c + 32 for c in range(65, 91)})).split() for t in texts]
    own = [Counter(tuple(d[i : i + k]) for k in range(order + 1) for i in range(len(d) - k + (k > 0))) for d in docs]
    for d, c in zip(docs, own, strict=True):
        c[()] = len(d)
    total = sum(own, Counter())
    out = []
    for d, c in zip(docs, own, strict=True):
        s = 0.0
        for i in range(len(d)):
            for back, k in enumerate(range(min(order, i + 1), -1, -1)):
                gram = tuple(d[i - k + 1 : i + 1]) if k else ()
                if k == 0:
                    s += back * math.log(alpha) - math.log(max(total[()] - c[()], 1))
                elif total[gram] - c[gram] > 0:
                    s += back * math.log(alpha) + math.log((total[gram] - c[gram]) / (total[gram[:-1]] - c[gram[:-1]]))
                    break
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, prose, order):
    docs = [*prose[:40], (900, prose[0][1], None, None, None), (901, "unseen words only", None, None, None), (902, "", None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_tokens, r.score) for r in L.score_documents(df, order, block_bytes=3000).collect()}
    for (i, *_), (n, s) in zip(docs, brute([d[1] for d in docs], order), strict=True):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=2e-6)


def test_edges(edge_docs, no_docs):
    got = L.score_documents(edge_docs).collect()
    assert len(got) == 9 and all(r.score == 0 for r in got if r.doc_id in (1, 2))
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert L.score_documents(no_docs).count() == 0


def test_bytes_planes():
    import numpy as np

    x = np.array([0, 1, 2**63, 77], np.uint64)
    assert (L.unpack(L.pack(x), np.uint64) == x).all()
