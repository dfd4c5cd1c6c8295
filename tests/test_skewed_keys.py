"""Current rows and per-key results against brute force, with a key in a third of all rows."""

import datetime as dt
import random

import pytest

from folioscope.operators.current import current_rows
from folioscope.operators.skewed_keys import heavy_keys, key_counts, key_results

SCHEMA = "paper_id bigint, author_ids array<bigint>, categories array<string>, date date, ts timestamp, field string, item_key string"


def data(n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        ids = [rng.choice([7, rng.randint(10, 60), None]) for _ in range(rng.randint(0, 5))]
        cats = rng.choice([None, [], ["a"], ["a", "b", "a"], [None, "c"]])
        rows.append((i, None if i % 50 == 0 else ids, cats, None if i % 9 == 0 else dt.date(2000 + i % 20, 1, 1), dt.datetime(2020, 1, 1), "clash", "clash"))
    return rows


def brute(rows):
    out = {}
    for pid, ids, cats, day, *_ in rows:
        ids_ = {x for x in ids or [] if x is not None}
        for field, keys in (("author_ids", ids_), ("categories", {c for c in cats or [] if c is not None})):
            for k in keys:
                papers, days, co = out.setdefault((field, str(k)), (set(), [], set()))
                papers.add(pid)
                if day:
                    days.append(day)
                co |= {x for x in ids_ if not (field == "author_ids" and x == k)}
    return {k: (len(p), min(d, default=None), max(d, default=None), len(c)) for k, (p, d, c) in out.items()}


def test_results_equal_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.field, r.item_key): (r.papers, r.first_date, r.last_date, r.coauthors) for r in key_results(df, "paper_id", ["author_ids", "categories"], "date", "author_ids").collect()}
    assert got == brute(rows)
    counts = {(r.field, r.item_key): r.papers for r in key_counts(df, "paper_id", ["author_ids", "categories"], "date").collect()}
    assert counts == {k: v[0] for k, v in got.items()}
    heavy = {tuple(r) for r in heavy_keys(df, "paper_id", ["author_ids", "categories"], "date", 0.1, 20).collect()}
    assert heavy == {k for k, v in got.items() if v[0] >= 20 and v[0] >= 0.1 * len(rows)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_results(df, "paper_id", ["author_ids"], "date", "author_ids").count() == 0
    assert heavy_keys(df, "paper_id", ["author_ids"], "date", 0.02, 20).count() == 0


def test_current_rows(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    df = spark.createDataFrame([(1, "a", t(1)), (1, "b", t(3)), (1, "b", t(3)), (2, None, t(5)), (2, "x", t(4)), (None, "n", t(9)), (3, "only", None)], "k int, v string, ts timestamp")
    assert {tuple(r) for r in current_rows(df, "k", "ts", ["v"]).collect()} == {(1, "b"), (2, None), (3, "only")}


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_current_wide_rows(spark, monkeypatch, keys):
    from folioscope.operators import current

    monkeypatch.setattr(current, "BROADCAST_KEYS", keys)
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [(1, t(1), ["a"]), (1, t(3), ["b"]), (1, t(3), ["b"]), (2, None, ["c"]), (2, t(1), None), (3, t(1), None), (None, t(1), ["x"]), (4, None, ["y"]), (4, None, ["y"])]
    df = spark.createDataFrame(rows, "k int, ts timestamp, v array<string>").repartition(3)
    wide, plain = current.current_wide_rows(df, "k", "ts", ["v"]), current.current_rows(df, "k", "ts", ["v"])
    assert sorted(map(str, wide.collect())) == sorted(map(str, plain.collect())) and wide.count() == 4
    assert current.current_wide_rows(df.limit(0), "k", "ts", ["v"]).count() == 0
