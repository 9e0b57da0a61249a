import random
import re

from spanloom.llm import secret_scan as S


def brute(text):
    out = []
    for m in re.finditer(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], S.KINDS.index(x[0])))


def spans(text):
    raw = text.encode()
    return S.in_code_points(raw, S.byte_spans(raw))


def test_random_texts_against_expressions():
    rng = random.Random(0)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "AKIA", "akia", '"', "'", " ", "=", ":", "abcdef0123456789", "0a", "f", "é", "😀", "ſ", "K", "ABCDEFGHIJKLMNOP", "Zz9+/_.=-", "passwordpassword="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [x for x in spans(text) if x[0] != "checked"] == brute(text), text


def test_checksum_decides():
    body = b"z" * 30
    good = b"ghp_" + body + S.checksum(body).encode()
    assert spans(f"x {good.decode()} y") == [("checked", 2, 42)]
    assert spans(f"x {good.decode()[:-1]}! y") == [] and spans(good.decode().replace("zzz", "zyz", 1)) == []


def test_edges(edge_docs, no_docs):
    got = {r.doc_id: r for r in S.scan_secrets(edge_docs).collect()}
    assert got[1].spans == "" and got[7].spans == "assign:3:30" and got[7].n_assign == 1
    assert S.scan_secrets(no_docs).count() == 0
