"""Encoding by the monoid tree equals direct encoding; mixtures keep their budgets."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import mixing as mx
from folioscope.llm import tokens as tk

ENC = tk.encoder(tk.DEFAULT_TOKENIZER)
ALPHABET = "ab zZ'’s\n\t  1é中!?-lvre\x1c　\x85😀<|endoftext|>١"


@given(st.text(alphabet=ALPHABET, max_size=160), st.integers(1, 40))
@settings(max_examples=400, deadline=None)
def test_tree_equals_direct(text, leaf):
    ids = tk.encode(ENC, text, leaf)
    assert ids == ENC.encode_ordinary(text) and tk.decode(ENC, ids) == text


@given(st.text(max_size=120), st.integers(1, 25))
@settings(max_examples=200, deadline=None)
def test_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert tk.encode(ENC, text, leaf) == ENC.encode_ordinary(text)


def test_without_any_cut():
    text = "x" * 3000
    assert tk.encode(ENC, text, 64) == ENC.encode_ordinary(text)


def test_ids_of_a_table(spark):
    long_ = " ".join(f"word{i} it's" for i in range(4000))
    rows = [(1, None, "k"), (2, "", "k"), (3, "  \n ", "k"), (4, "<|endoftext|>", "k"), (5, long_, "k"), (5, long_, "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = {r.doc_id: r.ids for r in tk.token_ids(df, "text", ["doc_id"]).collect()}
    assert got == {i: (ENC.encode_ordinary(t) if t else []) for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in tk.token_counts(df, "text", ["doc_id"]).collect()}[5] == len(got[5])
    assert tk.token_ids(df.limit(0), "text", ["doc_id"]).count() == 0


def test_share_out():
    assert mx.share_out(10, [1, 1], [100, 100]) == [5, 5]
    assert mx.share_out(10, [1, 1], [2, 100]) == [2, 8]
    assert mx.share_out(100, [3, 1, 1], [10, 5, 1]) == [10, 5, 1]
    assert mx.share_out(10, [1, 0], [4, 100]) == [4, 6]
    assert mx.share_out(6, [1, 2, 3], [10, 1, 10]) == pytest.approx([1.25, 1, 3.75])


def documents(spark, n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["mid"] * 2 + ["small", None, "unlisted"])
        rows.append((i, source, rng.choice(["en", "EN ", "de", None]), rng.choice([0, rng.randint(1, 200)]), "clash"))
    return spark.createDataFrame(rows, "doc_id int, source string, lang string, n_tokens bigint, epoch string").repartition(4)


def test_mixture(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mx.mix_sources(docs, targets, domains={"small": "d", "mid": "d"})
    rows = mixture.collect()
    used = {}
    for r in rows:
        used.setdefault((r.doc_id, r.source), []).append(r.epoch)
    most = {"big": 1, "mid": 2, "small": 2}
    assert all(len(e) == len(set(e)) and max(e) <= most[s] for (_, s), e in used.items())
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "mid", "small", "none"} and got["none"].used_tokens == 0
    for s, r in got.items():
        assert r.used_tokens == sum(x.n_tokens for x in rows if x.source == s)
        assert abs(r.used_tokens - r.budget_tokens) <= 4 * 200  # at most a document per leaf
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    assert got["small"].used_tokens == 2 * got["small"].available_tokens  # short, so used up
    again, _ = mx.mix_sources(docs.repartition(7), targets, domains={"small": "d", "mid": "d"})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_the_largest_mixture_that_keeps_the_shares(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mx.mix_sources(docs, targets, total=mx.REACHABLE)[1].collect()}
    most = {s: r.available_tokens * r.max_repeats for s, r in rows.items()}
    total = int(min(most[s] / r.target_share for s, r in rows.items()))
    assert all(r.reachable_tokens == total and r.distance < 0.01 for r in rows.values())
    assert abs(sum(r.used_tokens for r in rows.values()) - total) < 12 * 200 and abs(rows["big"].off_target) < 0.01
    whole = {r.source: r for r in mx.mix_sources(docs, targets)[1].collect()}
    assert whole["small"].distance == pytest.approx(sum(abs(r.actual_share - r.target_share) for r in whole.values()) / 2)
    with_none = spark.createDataFrame([("big", 0.5, 1), ("none", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert {r.reachable_tokens for r in mx.mix_sources(docs, with_none)[1].collect()} == {int(whole["big"].available_tokens / 0.5)}


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, None)], "source string, target_share double, max_repeats int")
    mixture, report = mx.mix_sources(documents(spark).limit(0), targets)
    assert mixture.count() == 0 and report.first().used_tokens == 0
