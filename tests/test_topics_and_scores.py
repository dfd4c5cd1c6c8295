"""Chunks, neighbours, clustering, trees, scores and evaluation against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import author_ids as aid
from folioscope.operators import dendrogram as tree
from folioscope.operators import evaluation as ev
from folioscope.operators import manifold as mf
from folioscope.operators import scoring as sc
from folioscope.operators import temporal as tm
from folioscope.operators import topic_models as tp
from folioscope.operators import vocabulary as vo


def test_chunks(spark):
    days = [dt.date(2000, 3, 5), dt.date(2000, 4, 1), dt.date(2000, 6, 30), dt.date(2000, 7, 1), dt.date(2001, 1, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "paper_id int, date date")
    c = tm.with_chunks(df, 3)
    assert {r.paper_id: r.chunk_id for r in c.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 4}
    stats = tm.chunk_statistics(c)
    assert [(r.chunk_id, r.chunk, r.n) for r in stats.orderBy("chunk").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 1), (4, 3, 1)]
    sizes = tm.smoothing_sizes(spark.createDataFrame([(0, 10), (1, 100), (2, 3)], "chunk bigint, n bigint"), 0.3)
    assert {(r.base, r.chunk): r.wanted for r in sizes.collect()} == {(1, 0): 3, (0, 1): 30, (2, 1): 30}
    with pytest.raises(ValueError):
        tm.smoothing_sizes(stats, 1.0)


def test_linkage_and_cut():
    x = np.array([0.0, 0.1, 1.0, 1.1, 5.0])[:, None]
    d = np.abs(x - x.T)
    z = mf.linkage(d, "average")
    assert z[:2, :2].tolist() == [[0, 1], [2, 3]] and abs(z[2, 2] - 1.0) < 1e-9
    assert mf.cut(z, 0.5) == [1, 1, 2, 2, 3] and mf.cut(z, 0.99, True) == [1, 1, 1, 1, 2] and mf.cut(z, 100) == [1] * 5
    ward = mf.linkage(d, "ward")
    assert abs(ward[2, 2] - np.sqrt(2) * 1.0) < 1e-9  # two pairs whose centres are 1 apart: sqrt(2 * 2 * 2 / 4) * 1
    assert mf.linkage(np.zeros((1, 1))).shape == (0, 4)
    with pytest.raises(ValueError):
        mf.rescaled(2, 0, 1)


def test_embedding_and_path():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = mf.classical_scaling(d, 3)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d, atol=1e-6)
    assert mf.potential_embedding(d, 2).shape == (40, 2) and mf.principal_axes(x, 2).shape == (40, 2)
    path = mf.smooth_path(x, n=8, tolerance=0.2)
    assert len(path) <= 8 and mf.refined_path(x, path) == path  # a neighbour itself may take a point's place


def test_tree_tables(spark):
    z = mf.linkage(np.array([[0, 1, 4.0], [1, 0, 5], [4, 5, 0]]), "single")
    nodes, closure = tree.tree_tables(spark, z, [0, 1, 2])
    assert {(r.node, r.leaves) for r in nodes.collect()} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert {r.leaf for r in closure.where("node = 4").collect()} == {0, 1, 2}
    assert tree.preorder(z, 3)[0] == 4 and tree.postorder(z, 3)[-1] == 4
    assert {(r.a, r.b): r.node for r in tree.common_ancestors(closure, nodes).collect()} == {(0, 1): 3, (0, 2): 4, (1, 2): 4}
    assert {r.node for r in tree.truncate(nodes, 2.0).collect()} == {3, 2}
    assert tuple(tree.height_range(nodes).first()) == (1.0, 4.0)


def test_link_probability(spark):
    rng = np.random.default_rng(2)
    left, right = rng.uniform(0, 0.5, (2, 6))
    e = [(0, 1), (1, 2), (2, 5), (3, 4)]
    mass = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(left)] + [(2, i, float(x)) for i, x in enumerate(right)], "node int, author_id bigint, p double")
    got = tree.link_probabilities(spark.createDataFrame([(0, 1, 2)], "node int, left int, right int"), mass, spark.createDataFrame(e, "src bigint, dst bigint")).first()
    x, y = left * (1 - right), right * (1 - left)
    assert abs(got.probability - sum(x[u] * y[v] + x[v] * y[u] for u, v in e) / (x.sum() * y.sum())) < 1e-12


def test_document_scores(spark):
    theta = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.5), (2, 1, 1.0)], "d int, topic int, p double")
    got = {r.d: r.score for r in sc.document_scores(theta, "d", 5).collect()}
    for d, v in ((1, [0.5, 0, 0, 0.5, 0]), (2, [0, 1, 0, 0, 0])):
        q = np.array(v) + 1e-10
        q /= q.sum()
        assert abs(got[d] + (q * np.log2(q)).sum()) < 1e-9


def test_kendall_tau(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 9, 60)
    frame = lambda v: spark.createDataFrame([(i, int(s)) for i, s in enumerate(v)], "id int, score int")
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    want = (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())
    assert abs(sc.kendall_tau(frame(x), frame(y), "id").first()[0] - want) < 1e-12
    assert sc.kendall_tau(frame(x * 0), frame(y), "id").first()[0] is None


def test_silhouette(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (25, 3))])
    lab = [0] * 20 + [1] * 25
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, lab))], "id int, v array<double>, l int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(45):
        own = [j for j in range(45) if lab[j] == lab[i] and j != i]
        oth = [j for j in range(45) if lab[j] != lab[i]]
        a, b = d[i, own].mean(), d[i, oth].mean()
        s.append((b - a) / max(a, b))
    assert abs(ev.silhouette(df, "id", "v", "l").first()[0] - np.mean(s)) < 1e-6


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, ["w1", "w2", "w1", "zz"]), (2, ["w2", "w3"]), (3, []), (4, None)], "d int, t array<string>")
    assert {r.term: (r.df, r.cf) for r in vo.term_frequencies(df, "d", "t").collect()} == {"w1": (1, 2), "w2": (2, 2), "w3": (1, 1), "zz": (1, 1)}
    kept = vo.keep_terms(df, "d", "t", spark.createDataFrame([("w1",), ("w2",)], "term string"))
    assert {r.d: r.t for r in kept.collect()} == {1: ["w1", "w2", "w1"], 2: ["w2"]}
    with pytest.raises(ValueError):
        vo.relevance(df, 1.5)


def test_author_ids(spark):
    rows = [(1, ["Johnathan Doebrich", "Ann Roe"]), (2, ["JOHNATHAN DOEBRICHT", "3x"]), (3, [f"N{i} M" for i in range(30)]), (4, None)]
    p = spark.createDataFrame(rows, "paper_id int, author_names array<string>")
    names = aid.standard_names(p.where("paper_id < 3"))
    pairs = {(r.a, r.b): r.similarity for r in aid.similar_names(names, 0.7).collect()}
    assert list(pairs) == [("JOHNATHAN DOEBRICH", "JOHNATHAN DOEBRICHT")]
    m = aid.author_map(names, 0.7)
    ids = {r.name: r.author_id for r in m.collect()}
    assert ids["JOHNATHAN DOEBRICH"] == ids["JOHNATHAN DOEBRICHT"] != ids["ANN ROE"] and min(ids.values()) >= 10**6
    got = {r.paper_id: r.author_ids for r in aid.assign_author_ids(p, m).collect()}
    assert got[1] == [ids["JOHNATHAN DOEBRICH"], ids["ANN ROE"]] and got[2] == [ids["JOHNATHAN DOEBRICH"]] and got[3] == [] and got[4] == []


def test_lda(spark):
    docs = spark.createDataFrame([(i, ["apple", "pear"] * 4 if i % 2 else ["wolf", "bear"] * 4) for i in range(30)] + [(99, [])], "d int, t array<string>")
    model = tp.fit_topics(docs, "t", 2, rounds=10)
    phi = model.phi(docs).groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert len(phi) == 2 and all(abs(r.s - 1) < 1e-6 for r in phi)
    theta = model.theta(docs.where("d < 99"), "d").groupBy("d").agg(F.sum("p").alias("s"), F.max("p").alias("m")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in theta)
    assert len(model.top_terms(0, 2)) == 2 and model.perplexity(docs.where("d < 99")) > 0
    with pytest.raises(ValueError):
        tp.fit_topics(docs.where("d = 99"), "t", 2)
