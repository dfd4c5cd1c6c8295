"""Co-occurring items and term frequencies against brute force."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from folioscope.llm import cooccurrence as co
from folioscope.llm import frequency as fr


def brute_pairs(lists):
    sets = [sorted({x for x in ids if x is not None}) for ids in lists if ids]
    sets = [s for s in sets if s]
    one = collections.Counter(x for s in sets for x in s)
    two = collections.Counter(p for s in sets for p in itertools.combinations(s, 2))
    n = len(sets)
    out = {}
    for (a, b), c in two.items():
        t = [c + 0.5, one[a] - c + 0.5, one[b] - c + 0.5, n - one[a] - one[b] + c + 0.5]
        out[a, b] = (c, one[a], one[b], n, round(c * n / (one[a] * one[b]), 9), round(t[0] * t[3] / (t[1] * t[2]), 9))
    return out


def check_pairs(spark, lists):
    df = spark.createDataFrame([(i, ids, "clash") for i, ids in enumerate(lists)], "paper_id int, author_ids array<bigint>, code string").repartition(3)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, round(r.lift, 9), round(r.odds_ratio, 9)) for r in co.pair_counts(df, "author_ids").collect()}
    assert got == brute_pairs(lists)


def test_pairs(spark):
    rng = random.Random(1)
    lists = [rng.choice([None, [], [None], [5, 5, None]]) if i % 10 == 0 else [rng.choice([3, rng.randint(0, 40)]) for _ in range(rng.randint(1, 7))] for i in range(300)]
    check_pairs(spark, lists)
    df = spark.createDataFrame([(x,) for x in lists], "author_ids array<bigint>")
    kept = {(r.item_a, r.item_b) for r in co.pair_counts(df, "author_ids", 5).collect()}
    assert kept == {p for p, v in brute_pairs(lists).items() if v[0] >= 5}


def test_pairs_far_apart_ids_and_negative(spark):
    far = [-(2**62), -7, 0, 2**62, 2**40]
    check_pairs(spark, [[far[i % 5], far[(i * 3 + 1) % 5], far[0]] for i in range(20)])


def test_pairs_long_record_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(co, "RUN_CODES", 1000)
    values = list(range(200))
    pieces = list(co._pairs(co.np.array(values * 2), co.np.array([200, 200])))
    assert sum(map(len, pieces)) == 2 * 200 * 199 // 2 and len(pieces) > 10
    check_pairs(spark, [values, values[:3]])


def test_pairs_empty(spark):
    df = spark.createDataFrame([], "author_ids array<bigint>")
    assert co.pair_counts(df, "author_ids").count() == 0


def brute_ngrams(docs, n):
    occ, rec, total = collections.Counter(), collections.Counter(), 0
    for terms in docs:
        terms = [t.strip().lower() for t in terms or [] if t is not None and t.strip()]
        total += bool(terms)
        grams = [tuple(terms[i : i + k]) for k in range(1, n + 1) for i in range(len(terms) - k + 1)]
        occ.update(grams)
        rec.update(set(grams))
    return {g: (occ[g], rec[g]) for g in occ}, total


def test_ngrams(spark):
    rng = random.Random(2)
    docs = [rng.choice([None, [], ["", None]]) if i % 12 == 0 else [rng.choice(["a", "A ", "\ta", "b", "c d", "", None, rng.choice("xyz")]) for _ in range(rng.randint(1, 12))] for i in range(200)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(docs)], "paper_id int, t array<string>, n int, suffix string").repartition(4)
    for n in (1, 2, 3):
        counts, total = fr.ngram_counts(df, fr.normalised_terms(F.col("t")), n)
        want, number = brute_ngrams(docs, n)
        assert {tuple(r.ngram): (r.occurrences, r.records) for r in counts.collect()} == want and total == number
    marked = {r.ngram[0]: r.mark for r in fr.term_marks(*fr.ngram_counts(df, fr.normalised_terms(F.col("t")))).collect()}
    one, number = brute_ngrams(docs, 1)
    assert marked == {g[0]: "rare" if v[1] <= 2 else "common" if v[1] > 0.3 * number else None for g, v in one.items()}


def test_ngrams_empty(spark):
    counts, total = fr.ngram_counts(spark.createDataFrame([], "paper_id int, t array<string>"), fr.normalised_terms(F.col("t")), 2)
    assert counts.count() == 0 and total == 0


def test_tables_that_are_full(spark, monkeypatch):
    monkeypatch.setattr(fr, "TABLE_SUFFIXES", 5)
    rng = random.Random(4)
    docs = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 15))] for _ in range(80)]
    merged = collections.Counter()
    for n in (1, 3):
        tables = list(fr._runs(iter(docs), n))
        assert len(tables) > 10
        merged = collections.Counter()
        for t in tables:
            for k, v in t.items():
                merged[k] += v[0]
        assert merged[()] == sum(map(bool, docs)) and sum(v for k, v in merged.items() if k) == sum(map(len, docs))


def test_the_stack_adds_up_equal_suffixes():
    suffixes = [["b", "a"], ["b", "a"], ["b"], ["a", "c"], ["a", "b"], ["a", "b"], ["a"]]
    batch = fr.pa.RecordBatch.from_arrays([fr.pa.array(suffixes), fr.pa.array([1, 2, 3, 1, 1, 1, 1]), fr.pa.array([[1, 1], [2, 2], [1, 0], [1, 1], [0, 1], [1, 1], [1, 0]])], ["s", "n", "f"])
    got = {tuple(g): (n, r) for out in fr._stack(iter([batch])) for g, n, r in zip(*(out.column(i).to_pylist() for i in range(3)))}
    assert got == {("b", "a"): (3, 3), ("b",): (6, 4), ("a", "c"): (1, 1), ("a", "b"): (2, 2), ("a",): (4, 3)}
