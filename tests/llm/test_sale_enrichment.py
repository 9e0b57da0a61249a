"""The stream against a plain run of its rules, batch by batch, with hot clients, ties, nulls, late and repeated rows."""

import random
from datetime import datetime, timedelta

import pytest

from spanloom.llm import sale_enrichment as E

HOUR = 3_600_000_000
SALES = "id long, client long, us long, batch int"
CHANGES = "id long, client long, us long, seq long, cents long, op string, batch int"


def brute(sales, changes, batches, delay):
    low = -(1 << 62)
    mark = lambda rows, b: max((r[2] for r in rows if r[-1] < b and r[2] is not None), default=low + delay) - delay
    order = lambda c: (c[2], c[3] is not None, c[3] or 0, c[0] is not None, c[0] or 0)
    held, waiting, out, h = {}, [], [], low
    for b in range(batches + 1):
        wc = mark(changes, b)
        h = min(mark(sales, b), wc)
        for c in (c for c in changes if c[-1] == b):
            if c[2] < wc:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        waiting += [s for s in sales if s[-1] == b]
        ready = [s for s in waiting if b == batches or s[2] is None or s[2] < h]
        waiting = [s for s in waiting if s not in ready]
        for i, client, us, _ in ready:
            own = held.get(client, []) if client is not None else []
            before = [c for c in own if us is not None and c[2] <= us]
            found = max(before, key=order, default=(None,) * 7)
            out.append(("sale", i, b, len(own), found[0], found[4], found[5]))
        for client, own in held.items():
            settled = sorted((c for c in own if c[2] <= h), key=order)
            held[client] = settled[-1:] + [c for c in own if c[2] > h]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = 1_704_067_200_000_000
    client = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3, *range(4, 20)])
    at = lambda b: base + b * 20 * HOUR + rng.randint(-15, 25) * HOUR + rng.choice([0, 0, 1, 999, 1000])
    sales = [(i, client(), rng.choice([at(b), at(b), at(b), None]) if i % 17 == 0 else at(b), b) for b in range(3) for i in range(b * 100, b * 100 + 90)]
    changes = [(i, client(), at(b), rng.choice([None, 0, 1]), rng.choice([None, i]), rng.choice("IUD"), b) for b in (0, 2) for i in range(b * 100, b * 100 + 80)]
    return sales, changes


@pytest.mark.parametrize("bucket_rows", [15, 100_000])
def test_brute_force(spark, rows, bucket_rows):
    sales, changes = rows
    got = E.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), 4, 12, bucket_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(sales, changes, 4, 12 * HOUR)


def test_tables_with_broken_rows(spark):
    t = datetime(2024, 1, 2)
    sales = spark.createDataFrame([(1, 5, t, t, "x"), (1, 5, t, t, "x"), (2, 5, None, t, "x"), (3, None, t, None, "x"), (None, 9, t - timedelta(5), t, "x")], "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, op string")
    kinds = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, batch string"
    rows = [(7, 5, 0, "U", t, None, None, None, 1.005, "x"), (7, 5, 0, "U", t, None, None, None, 1.005, "x"), (8, 5, 1, "D", t, None, None, None, float("nan"), "x"), (9, 5, 2, "U", None, None, None, None, 1.0, "x"), (None, None, None, None, t, None, None, None, None, "x")]
    got = E.enrich_sales(sales, spark.createDataFrame(rows, kinds), batches=1).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("sale", 1, 1, 2, 8, None, "D")] * 2 + [("sale", 2, 0, 2, None, None, None), ("sale", 3, 1, 0, None, None, None), ("sale", None, 1, 0, None, None, None)], key=str)


def test_empty_tables(spark):
    got = E.enrich(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES), 1)
    assert got.columns == ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"] and got.count() == 0
