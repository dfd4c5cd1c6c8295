"""Vector kernels against numpy, text expressions against hand-made cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions import vectors as vec


def close(a, b):
    return abs(a - b) < 1e-9


def test_kernels(spark):
    rng = np.random.default_rng(3)
    p, q = rng.dirichlet(np.ones(12), 2)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    got = df.select(*[k("p", "q").alias(n) for n, k in vec.KERNELS.items()]).first()
    m = (p + q) / 2
    h = np.sqrt(0.5 * ((np.sqrt(p) - np.sqrt(q)) ** 2).sum())
    want = {
        "hellinger": h, "hellinger_similarity": 1 - h, "hellinger_decay": 1 / (1 + 10 * h), "euclidean": np.linalg.norm(p - q), "manhattan": abs(p - q).sum(),
        "cosine": p @ q / np.linalg.norm(p) / np.linalg.norm(q), "kl": (p * np.log(p / q)).sum(), "js": ((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2,
        "bhattacharyya": -np.log(np.sqrt(p * q).sum()), "tv_min": (abs(p - q) * np.minimum(p, q)).sum(), "tv_mean": (abs(p - q) * m).sum(), "inverse_l1": 1 / abs(p - q).sum(),
    }
    assert all(close(got[n], v) for n, v in want.items())


def test_kernel_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    r = df.select(vec.hellinger("a", "b"), vec.hellinger("a", "a"), vec.cosine("a", "z"), vec.gini("z"), vec.entropy_bits("a"), vec.hellinger("e", "e"), vec.kl_divergence("a", "b"), vec.argmax("b")).first()
    assert [float(x) for x in r] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        vec.kernel("no such")


def test_mean_cosine(spark):
    x = np.random.default_rng(1).normal(size=(30, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert close(vec.mean_pairwise_cosine(df, "v").first()[0], (s.sum() - 30) / (30 * 29))
    assert vec.mean_pairwise_cosine(df.limit(1), "v").first()[0] is None
    c = x.mean(axis=0)
    assert close(vec.density(df, "v").first()[0], np.mean(1 / np.abs(x - c).sum(axis=1)))


def test_tokens_and_lemmas(spark):
    df = spark.createDataFrame([("Hello World! This is a test.",), ("Café_x naïve 12ab _hid",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.simple_tokens("t")).collect()] == [["hello", "world", "this", "is", "test"], ["cafe_x", "naive", "ab"], [], []]
    words = spark.createDataFrame([(["running", "cats", "better", "studies", "boxes", "glass", "virus", "mice", "analyses"],)], "w array<string>")
    assert words.select(tx.lemmas("w")).first()[0] == ["running", "cat", "better", "study", "box", "glass", "virus", "mouse", "analysis"]


def test_names(spark):
    df = spark.createDataFrame([("John Doe",), ("ab",), ("  3x",), ("o'neil-x, d",), (None,)], "n string")
    grams = [r[0] for r in df.select(tx.name_ngrams("n")).collect()]
    assert grams[0] == [" Jo", "Joh", "ohn", "hn ", "n D", " Do", "Doe", "oe "] and grams[1] == []
    assert [r[0] for r in df.select(tx.standard_name("n")).collect()] == ["JOHN DOE", "AB", None, "O'NEIL-X, D", None]
    assert spark.range(1).select(tx.title_case(F.lit("o1neill x-ray d'or"))).first()[0] == "O1Neill X-Ray D'Or"


def test_dates(spark):
    df = spark.createDataFrame([("2019-07-25",), ("14.07.2016",), ("2020-02-30",), ("2019-07-25T10:00:00Z",), ("Mar 5, 2001",), ("x",), (None,), ("",)], "d string")
    assert [r[0] for r in df.select(tx.any_date("d")).collect()] == [dt.date(2019, 7, 25), dt.date(2016, 7, 14), None, dt.date(2019, 7, 25), dt.date(2001, 3, 5), None, None, None]
    assert [r[0] for r in df.select(tx.iso_date("d")).collect()] == [dt.date(2019, 7, 25), None, None, dt.date(2019, 7, 25), None, None, None, None]
