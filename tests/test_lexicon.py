"""The trie against n-gram joins and plain regular expressions; the sweep against its rule, pair by pair."""

import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import dictionary as D
from spanloom.operators import lexicon as L
from spanloom.operators import spans as S
from spanloom.operators import tokens
from spanloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PARTS = ("ab", "abs", "c", "s", "de", "fé", "g1")
GAPS = (" ", "  ", "-", "/", ", ", "\n", ":\n\n", "(", ") ")


def made(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(GAPS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(str(i), t) for i, t in enumerate(made(1, 60))] + [("none", None), ("empty", ""), ("long", "ab c " * 30000)]
    return spark.createDataFrame(rows, "note_id string, text string").cache()


@pytest.mark.parametrize("shard_bytes", [1 << 24, 400])
def test_terms_equal_the_ngram_join(spark, notes, monkeypatch, shard_bytes):
    monkeypatch.setattr(L, "SHARD_BYTES", shard_bytes)
    rng = random.Random(2)
    terms = sorted({" ".join(rng.choice(("ab", "abs", "c", "s", "de", "f", "g1")) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    lexicon = spark.createDataFrame([*enumerate(terms), (900, None), (901, ""), (902, terms[0])], "id long, term string")
    got = L.match_terms(notes, lexicon).groupBy("note_id", "start", "end", "id").count()
    want = tokens.ngram_table(notes, 4).join(lexicon, F.col("gram") == F.col("term")).groupBy("note_id", "start", "end", "id").count()
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() > 1000
    first = L.match_alternatives(notes, lexicon, "id").select("note_id", "start", "id")
    if shard_bytes > 400:
        assert first.exceptAll(want.groupBy("note_id", "start").agg(F.min("id").alias("id"))).count() == 0


@pytest.mark.parametrize("cased", [False, True])
def test_mentions_equal_regular_expressions(spark, notes, cased):
    mentions = ["ab", "ab c", "ab-c", "c/de", "(ab", "ab)", "de  ab", "s", "abs s", "g1", "c, de", "AB c"]
    lexicon = spark.createDataFrame([(m,) for m in mentions], "mention string")
    got = {(r.note_id, r.start, r.end, r.mention, r.in_header) for r in L.match_mentions(notes.where("note_id <> 'long'"), lexicon, skip_prefix=3, case_sensitive=cased).collect()}
    want = set()
    for note in notes.where("note_id <> 'long' AND text IS NOT NULL").collect():
        text = note.text if cased else note.text.lower()
        for m in mentions:
            words = r"\s+".join(re.escape(w).replace(r"\-", "[- ]").replace("/", "[/ ]") for w in re.split(r"\s+", m))
            for start in range(3, len(text)):
                end = max((x.end() for x in [re.compile(words + "s*", re.ASCII).match(text, start)] if x), default=None)
                # the whole run of a plural's s belongs to a match that ends at a word's end
                if end is None or start and text[start - 1].isalnum() or text[end : end + 1].isalnum():
                    continue
                line = text[: text.find("\n", start)] if "\n" in text[start:] else text
                want.add((note.note_id, start, end, m, line.rstrip().endswith(":")))
    # a mention whose folded key is empty matches nothing
    assert got == {x for x in want if x[3] != "s"} and len(got) > 300


def test_empty_lexicon_and_notes(spark, notes):
    lexicon = spark.createDataFrame([], "id long, term string")
    assert L.match_terms(notes, lexicon).count() == 0
    assert L.match_terms(notes.where("false"), spark.createDataFrame([(1, "ab")], "id long, term string")).count() == 0


def pairwise(rows):
    """The rule as it is told: each standing span, from left to right, meets those behind it that it overlaps."""
    gone = [False] * len(rows)
    for i, (_, end, weight) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if gone[i] or rows[j][0] >= end:
                break
            gone[i if weight < rows[j][2] else j] = True
    standing = [i for i, g in enumerate(gone) if not g]
    for i, g in enumerate(gone):
        if g and not any(rows[k][0] <= p < rows[k][1] for k in standing for p in rows[i][:2]):
            standing.append(i)
    return sorted(standing)


def test_sweep_follows_the_rule():
    rng = random.Random(4)
    for _ in range(3000):
        rows = sorted((s, s + rng.randint(1, 9), 0.0) for s in (rng.randint(0, 25) for _ in range(rng.randint(0, 14))))
        rows = [(s, e, e - s - 0.1 * rng.randint(0, 1)) for s, e, _ in rows]
        assert S.sweep(rows) == pairwise(rows)


def test_large_lexicon_takes_one_pass(spark, notes, monkeypatch):
    """However many shards the terms would fill, the notes are read once; a map too small for the keys drops no match."""
    lexicon = spark.createDataFrame([(f"{a} {b}", i) for i, (a, b) in enumerate((a, b) for a in PARTS for b in PARTS)], "term string, id long")
    whole = L.match_terms(notes, lexicon)
    monkeypatch.setattr(L, "SHARD_BYTES", 300)
    for bits in (6, 27):
        monkeypatch.setattr(L, "SLOT_BITS", bits)
        parts = L.match_terms(notes, lexicon)
        assert parts.columns == whole.columns and parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert parts.exceptAll(whole).count() == 0 == whole.exceptAll(parts).count() and parts.count() > 500


@pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")
@pytest.mark.parametrize("name", ["static_ratio", "linker_dictionary"])
def test_surfaces_come_with_their_tokens(spark, name):
    """No text is joined to spans that are made of tokens."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "__text" not in plan


@pytest.mark.parametrize("cased", [False, True])
def test_large_lexicon_of_mentions_takes_one_pass(spark, notes, monkeypatch, cased):
    """Signs around mentions, plurals, starts and ends of texts and header lines; the same as the tries of one shard find."""
    more = spark.createDataFrame([("m1", "a.b (c) x\n\nhead (a):\n(a) as-b ss a/b b-a"), ("m2", "(c)"), ("m3", "-a ssb\n a:  \n"), ("m4", None)], "note_id string, text string")
    both = notes.select("note_id", "text").unionByName(more)
    mentions = ["a", "b", "(a)", "(c)", "((c))", "-a", "a-b", "a b", "a/b", "a ss", "s", "ss", "a.b", "x", ". c", "A", "head (a):", None, "a"]
    entries = spark.createDataFrame([(m, i) for i, m in enumerate(mentions)], "mention string, concept_id long")
    rows = lambda: sorted(map(tuple, L.match_mentions(both, entries, 3, 0, cased).collect()))
    one = rows()
    assert len({r[3] for r in one}) > 8 and {r[-1] for r in one} == {True, False}
    monkeypatch.setattr(L, "SHARD_BYTES", 100)
    monkeypatch.setattr(L, "_shards", lambda *_: pytest.fail("a pass for each shard"))
    for bits in (6, 27):
        monkeypatch.setattr(L, "SLOT_BITS", bits)
        assert rows() == one


def test_spelled_is_the_expression():
    rng = random.Random(5)
    for _ in range(20000):
        mention, surface = ("".join(rng.choice(signs) for _ in range(rng.randint(1, 5))) for signs in ("ab -/s\n(", "ab -/s\n(\u00a0"))
        for other in (surface, mention + "s" * rng.randint(0, 2), mention.replace("-", " ").replace(" ", "  ")):
            assert L.spelled(mention, other) == bool(L.spelling(mention).fullmatch(other)), (mention, other)


@pytest.mark.parametrize("size", [150, 700, 16 << 20])
def test_longest_terms(spark, monkeypatch, size):
    """Weighed terms, split between the trie and the join at any size, are taken as longest_wins() takes all hits."""
    rng = random.Random(size)
    words = ["a", "bb", "ccc", "dd", "e1", "f"]
    texts = [(str(i % 40), rng.choice([None, ""]) if i % 17 == 0 else rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(44)]
    notes = spark.createDataFrame([*texts, (None, "a bb")], "note_id string, text string").repartition(3)
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    lexicon_ = spark.createDataFrame([(t, i, rng.choice([1, 2, 5, 9000, None])) for i, t in enumerate(terms)] + [("", 99, 3), (None, 98, 3)], "term string, concept_id long, n long")
    once = notes.groupBy("note_id").agg(F.first("text").alias("text")).localCheckpoint()
    want = S.longest_wins(L.match_terms(once, lexicon_.select("term", "concept_id")).select("note_id", "start", "end", "concept_id", "term"))
    monkeypatch.setattr(L, "SHARD_BYTES", size)
    got = L.longest_terms(once, lexicon_, "n").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert L.longest_terms(once.where("false"), lexicon_, "n").count() == 0 == L.longest_terms(once, lexicon_.where("false"), "n").count()


def test_longest_of_long_chains(monkeypatch):
    """Chains taken together in rounds, or one by one behind them, are chosen as by hand."""
    rng = np.random.default_rng(5)
    for rounds in (0, 1, 32):
        monkeypatch.setattr(S, "ROUNDS", rounds)
        for _ in range(60):
            note, start = np.sort(rng.integers(0, 4, 50)), rng.integers(0, 60, 50)
            end = start + rng.integers(0, 9, 50)
            by = np.lexsort((end, start, note))
            start, end = start[by], end[by]
            kept = []
            for i in np.lexsort((np.arange(50), -end, start - end, note)).tolist():
                if start[i] >= end[i] or not any(note[k] == note[i] and max(start[k], start[i]) < min(end[k], end[i]) for k in kept):
                    kept.append(i)
            got = S.longest_of(start.astype(np.int32), end.astype(np.int32), np.arange(50), S.chain_bounds(note, start, end))
            assert got.tolist() == sorted(kept)


def test_counted_gold(spark):
    """Counted in the pass that finds them, gold terms and keys are those of the spans themselves."""
    from spanloom.operators import dictionary as D
    from spanloom.plans import inputs as I

    spans = I.gold(spark, SF, "doc_id % 5 <> 0", named=True, term=True)
    want = D.counted_terms(spans, I.train_notes(spark, SF))
    counted = I.counted_terms(spark, SF)
    assert sorted(map(tuple, counted.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    keys = D.linker_dictionary(spans, I.train_notes(spark, SF))
    assert sorted(map(tuple, D.linker_keys(counted).collect())) == sorted(map(tuple, keys.collect()))


@pytest.mark.parametrize("size", [150, 16 << 20])
def test_choices_along_texts(spark, monkeypatch, size):
    """Alternation, the weighted sweep and first overlaps decided where the texts are, as from rows of all hits."""
    rng = random.Random(size)
    words = ["a", "bb", "ccc", "dd", "e1"]
    texts = [(str(i), None if i % 13 == 0 else rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randrange(50)))) for i in range(60)]
    notes = spark.createDataFrame(texts, "note_id string, text string").repartition(3).localCheckpoint()
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(50)})
    weighed = spark.createDataFrame([(t, i, rng.choice([1, 2, 9, None])) for i, t in enumerate(terms)], "term string, concept_id long, n long")
    hits = D.term_hits(notes, weighed, 3).localCheckpoint()
    marked = lambda df: df.withColumn("any_section", F.length("term") % 2 == 0)
    rows = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    span, pair = ("note_id", "start", "end", "concept_id", "term"), ("note_id", "start1", "end1", "start2", "end2")
    monkeypatch.setattr(L, "SHARD_BYTES", size)
    assert rows(D.alternate_terms(notes, weighed, 3), *span) == rows(S.alternation_scan(hits.withColumn("dict_ord", F.col("term"))), *span) != []
    assert rows(D.settled_terms(notes, marked(weighed), 3), *span, "ord") == rows(S.remove_overlaps(marked(hits)), *span, "ord") != []
    assert rows(D.first_term_overlaps(notes, weighed, 3), *pair) == rows(S.first_overlaps(hits), *pair) != []
    assert D.first_term_overlaps(notes.where("false"), weighed, 3).count() == 0 == D.alternate_terms(notes, weighed.where("false"), 3).count()


@pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")
@pytest.mark.parametrize("name", ["longest_wins", "alternation_scan", "remove_overlaps", "overlap_pairs"])
def test_hits_are_no_rows(spark, name):
    """No window numbers or orders the hits."""
    assert "Window" not in registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
