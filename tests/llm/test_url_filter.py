"""Hosts, paths and rules against plain code; the template tree on made-up hosts, against a plain tree."""

import random
import re

from pyspark.sql import functions as F

from spanloom.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme/x", "http://", "http://A.Example.NET/en/5?q=/de/", "x://example.com/de/", "x://example.com/de", "x://notexample.com/de/1",
    "http://sub.example.com/DE/1", "ftp://a.org/fr/x#y", "http://a.org?x=1/fr/", "a://b://c.net/x", "http://u@h.org:80/fr/é/1", "http://net/", "http://net",
    "http://h.example/" + "deep/" * 40 + "end", "http://h.example/" + "x" * 100_000, "http://Ünï.org/fr/\n/2",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[4]]):
        name, verdict = rule(*parts(u))
        assert got[i] == (*parts(u), name, verdict or "allow"), u


def site(rng):
    """A host whose shop pages are labelled unwanted, whose blog is labelled wanted, and some pages without a label."""
    rows = []
    for i in range(400):
        slug = "".join(rng.choice("abcdefgh") for _ in range(8))
        rows += [(f"http://h.x/shop/{slug}/buy", True if i % 4 else None), (f"http://h.x/blog/{slug}", False if i % 3 else None), (f"http://h.x/new/{i}", None)]
    return rows


def test_templates_and_purity(spark):
    rows = site(random.Random(1)) + [(f"http://i.x/only/{i}", True) for i in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {(r.host, r.template, r.verdict) for r in U.judge(df, (), "bad").select("host", "template", "verdict").distinct().collect()}
    assert {("h.x", "/shop/*/buy", "block"), ("h.x", "/blog/*", "allow"), ("h.x", "/new/<n>", "allow"), ("i.x", "/*/*", "allow")} >= got and len(got) == 4


def test_similar_branches_merge(spark):
    """Two branches alike in what follows and in labels become one template; one that differs stays apart."""
    rows = [(f"http://h.x/{lang}/item/{i}", i % 2 == 0) for lang in ("aa", "bb") for i in range(200)] + [(f"http://h.x/cc/x{chr(97 + i % 2)}", True) for i in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {(r.template, r.verdict) for r in U.judge(df, (), "bad").collect()}
    assert got == {("/aa|bb/item/<n>", "allow"), ("/cc/xa|xb", "block")}


def plain_templates(paths):
    """host, segs -> template of counted paths, level by level."""
    tree = {k: () for k in paths}
    for d in range(max(len(s) for _, s in paths)):
        counts, totals = {}, {}
        for (host, segs), n in paths.items():
            if len(segs) > d:
                at = (host, tree[host, segs])
                counts[at, segs[d]] = counts.get((at, segs[d]), 0) + n
                totals[at] = totals.get(at, 0) + n
        named = {k for k, n in counts.items() if n >= U.LEAST_PAGES and n >= U.LEAST_SHARE * totals[k[0]]}
        tree = {(h, s): t + ((s[d] if ((h, t), s[d]) in named else "*",) if len(s) > d else ()) for (h, s), t in tree.items()}
    return tree


def test_templates_equal_a_plain_tree(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "en", "long"] + [f"w{i}" for i in range(300)]
    paths = {}
    for _ in range(3000):
        key = (rng.choice("xyz"), tuple(rng.choice(words[: rng.choice((3, 5, 305))]) for _ in range(rng.randint(0, 4))))
        paths[key] = paths.get(key, 0) + 1
    df = spark.createDataFrame([(h, list(s), n, 0, 0) for (h, s), n in paths.items()], "host string, segs array<string>, n long, unwanted long, wanted long")
    got = {(r.host, tuple(r.segs)): tuple(r.tmpl) for r in U.path_templates(df).collect()}
    assert got == plain_templates(paths)


def test_empty_table_and_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty).count() == 0
    one = spark.createDataFrame([(None, None)], "page_id long, url string")
    assert U.judge(one).select("page_id", "host", "path", "rule", "verdict").first() == (None, "", "", None, "allow")
    assert U.judge(one.withColumn("bad", F.lit(True)), (), "bad").first().purity < U.PURITY
