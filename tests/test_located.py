"""Located painting: whatever overlaps, the elements nest, and the text without elements is the text."""

import html
import random
import re

from spanloom.operators import present as P


def test_random_overlaps_nest(spark):
    rng = random.Random(7)
    texts = {str(i): "".join(rng.choice("ab<&> '\"é😀") for _ in range(rng.randint(0, 40))) for i in range(30)} | {"none": None}
    spans = lambda: [(n, s, s + rng.randint(0, 12)) for n, t in texts.items() for s in (rng.randint(0, 40) for _ in range(5))]
    colours = [(n, s, e, i, rng.choice(["red", "green"])) for i, (n, s, e) in enumerate(x for x in spans() if x[1] < x[2])]
    locates = [(n, s, e) for n, s, e in spans() + spans()]
    notes = spark.createDataFrame(list(texts.items()), "note_id string, text string")
    got = P.located_html(notes, spark.createDataFrame(colours, "note_id string, start int, end int, ord int, class string"), spark.createDataFrame(locates, "note_id string, start int, end int"))
    found = {r.note_id: r.html for r in got.collect()}
    assert found.keys() == texts.keys()
    for n, text in texts.items():
        text, open_, at, covered, ids = text or "", [], 0, {}, []
        for tag, plain in re.findall(r"(<[^>]*>)|([^<]+)", found[n]):
            if plain:
                for c in html.unescape(plain):
                    assert c == text[at]
                    for x in open_:
                        covered.setdefault(x[1], set()).add(at)
                    at += 1
            elif tag.startswith("</"):
                assert open_.pop()[0] == tag[2:-1]
            else:
                kind, attribute, name = re.match(r'<(\w+) ([\w-]+)="([^"]*)">', tag).groups()
                ids += [name] if attribute == "id" else []
                open_.append((kind, name))
        assert not open_ and at == len(text) and len(ids) == len(set(ids))
        want = {f"loc-{s}-{min(e, len(text))}": set(range(s, min(e, len(text)))) for m, s, e in locates if m == n and s < min(e, len(text))}
        named = {k: v for k, v in covered.items() if k.startswith("loc-")}
        assert len(named) == len(ids) and sorted(map(sorted, named.values())) >= [] and set(map(frozenset, want.values())) == set(map(frozenset, named.values()))
