import re
import textwrap

import duckdb
import pandas as pd
import pytest
from spanloom.llm import license_scan as L


def dice(w, s):
    grams = {f"{a} {b}" for a, b in zip(w, w[1:])}
    return 2 * len(grams & s) / (len(grams) + len(s)) if grams else 0


def normal(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def brute(docs, t=0.8):
    sets = {k: set(L.bigrams_of(v)) for k, v in L.TEMPLATES.items()}
    out = []
    for i, text in docs:
        if text is None:
            continue
        lines = text.split("\n")
        for name, s in sets.items():
            for at, unit in enumerate(lines):
                if (d := dice(normal(unit), s)) >= t:
                    out.append((i, "line", at, at, name, round(d, 6)))
            if len(lines) > 1 and (d := dice(normal(" ".join(lines)), s)) >= t:
                out.append((i, "text", -1, -1, name, round(d, 6)))
            w = [(x, at) for at, line in enumerate(lines) for x in normal(line)]
            n, regions = len(normal(L.TEMPLATES[name])), []
            for at in range(len(w) - 1):
                window = [x for x, _ in w[at : at + n]]
                if f"{window[0]} {window[1]}" in s and (d := dice(window, s)) >= t:
                    if regions and at - regions[-1][1] < n:
                        regions[-1] = (regions[-1][0], at, max(regions[-1][2], d))
                    else:
                        regions.append((at, at, d))
            for a, b, d in regions:
                last = max(x for x in range(b, min(b + n, len(w)) - 1) if f"{w[x][0]} {w[x + 1][0]}" in s)
                out.append((i, "window", w[a][1], w[last + 1][1], name, round(d, 6)))
    return sorted(out)


def test_against_brute_force(spark):
    mit = L.TEMPLATES["MIT"]
    docs = [(i, v) for i, v in enumerate(L.TEMPLATES.values())]
    docs += [(100, mit.replace("Software", "Program")), (101, "\n".join(mit[i : i + 80] for i in range(0, len(mit), 80))), (102, "prose\nReleased under the MIT License!\nmore"), (103, "licensed under cc by-nc 4.0"), (104, mit[: len(mit) // 2]), (105, None), (106, ""), (107, "\n\n"), (108, "LICENSED under the apache license version 2 0 or so")]
    wrapped = "\n".join(f"# {line}" for line in textwrap.wrap(mit, 80))
    code = "\n".join(f"x{i} = compute(y{i}, z{i})" for i in range(300))
    docs += [(200, f"{wrapped}\n{code}"), (201, f"{code}\n{wrapped}\n{code}\n{wrapped}"), (202, "All of this was released under the MIT license, they said, and more."), (203, wrapped + "\n" + wrapped)]
    got = sorted(tuple(r) for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs)
    assert {x[0] for x in got} >= set(range(len(L.TEMPLATES))) | {100, 101, 102, 103}
    assert (200, "window", 0, wrapped.count("\n"), "MIT", 1.0) in got
    assert [x[1:5] for x in got if x[0] == 202] == [("window", 0, 0, "MIT-notice")]
    assert len([x for x in got if x[0] == 201 and x[4] == "MIT"]) == 2
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    db = duckdb.connect()
    db.register("documents", frame)
    assert sorted(db.execute(L.scan_sql()).fetchall()) == got


@pytest.mark.parametrize("t", [0.6, 0.8, 0.95])
def test_anchors_are_necessary(t):
    for text in L.TEMPLATES.values():
        grams = L.bigrams_of(text)
        left = [g for g in grams if not set(g.split()) & L.anchors_of(grams, t)]
        assert 2 * len(left) / (len(left) + len(grams)) < t


def test_edges(edge_docs, no_docs):
    assert L.scan_licenses(edge_docs).count() == 0
    assert L.scan_licenses(no_docs).count() == 0
    assert L.scan_licenses(edge_docs, {}).count() == 0


def test_plan_has_no_python_or_shuffle(edge_docs, capsys):
    L.scan_licenses(edge_docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan
