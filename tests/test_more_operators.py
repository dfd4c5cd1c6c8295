"""Link tables of cut trees, document filters by graph, author maps carried on, window coherence, paths, helpers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import collections as co
from folioscope.operators import author_ids as aid
from folioscope.operators import dendrogram as tree
from folioscope.operators import evaluation as ev
from folioscope.operators import graph as gr
from folioscope.operators import manifold as mf


def test_link_table(spark):
    # ((0 1) (2 3)) 4: nodes 5 = 0+1, 6 = 2+3, 7 = 5+6, 8 = 7+4
    z = np.array([[0, 1, 0.1, 2], [2, 3, 0.2, 2], [5, 6, 0.6, 4], [4, 7, 0.9, 5]])
    nodes, closure = tree.tree_tables(spark, z, [10, 11, 12, 13, 14])
    p = spark.createDataFrame([(5, 0.5), (6, 0.6), (7, 0.7), (8, 0.8)], "node int, probability double")
    cells = tree.truncate(nodes, 0.5)
    assert sorted(r.node for r in cells.collect()) == [4, 5, 6]
    got = {(r.i, r.j): r.p for r in tree.link_table(closure, nodes, cells, p).collect()}
    assert got == {(5, 5): 0.5, (6, 6): 0.6, (4, 4): 0.0, (5, 6): 0.7, (6, 5): 0.7, (4, 5): 0.8, (5, 4): 0.8, (4, 6): 0.8, (6, 4): 0.8}
    assert {r.topic: r.leaf for r in tree.cut_groups(closure, cells).collect()} == {10: 5, 11: 5, 12: 6, 13: 6, 14: 4}
    leaves = tree.truncate(nodes, 0.05)
    assert tree.link_table(closure, nodes, leaves, p).count() == 25
    assert tree.link_table(closure.limit(0), nodes.limit(0), cells.limit(0), p).count() == 0


def test_documents_by_graph(spark):
    papers = spark.createDataFrame([(1, [1, 2]), (2, [2, 3]), (3, [5, 6]), (4, [9]), (5, [3, 1]), (6, None)], "paper_id int, author_ids array<bigint>")
    e = gr.coauthor_edges(papers)
    some = lambda df: sorted(r[0] for r in df.collect())
    assert some(gr.authors_by_degree(e, 2, 5)) == [1, 2, 3] and some(gr.authors_by_component(e, sizes=(2, 2))) == [5, 6]
    assert some(gr.authors_by_component(e, densities=(0.9, 1.0))) == [1, 2, 3, 5, 6]
    start = spark.createDataFrame([(2,)], "author_id bigint")
    docs, links = gr.documents_within(papers, e, gr.authors_connected_with(e, start))
    assert some(docs.select("paper_id")) == [1, 2, 5] and links.count() == 3
    assert gr.documents_within(papers, e, start.limit(0))[0].count() == 0


def test_author_map_goes_on(spark, tmp_path):
    names = spark.createDataFrame([("ROE, ANN",), ("DOE, BOB",)], "name string")
    first = aid.author_map(names)
    aid.save_map(first, str(tmp_path / "map"))
    old = aid.load_map(spark, str(tmp_path / "map"))
    ids = {r.name: r.author_id for r in old.collect()}
    more = spark.createDataFrame([("ABE, CAL",), ("ROE, ANN",)], "name string")
    new = {r.name: r.author_id for r in aid.author_map(more, known=old).collect()}
    assert new["ROE, ANN"] == ids["ROE, ANN"] and new["DOE, BOB"] == ids["DOE, BOB"] and new["ABE, CAL"] == max(ids.values()) + 1
    seen = spark.createDataFrame([("ZED", 77), ("ROE, ANN", ids["ROE, ANN"]), (None, 5), ("X", None)], "name string, author_id bigint")
    assert {r.name: r.author_id for r in aid.sync_map(old, seen).collect()} == {"ZED": 77, "ROE, ANN": ids["ROE, ANN"]}
    assert aid.sync_map(old, seen.limit(0)).count() == 2
    old.unionByName(old).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        aid.load_map(spark, str(tmp_path / "twice"))


def brute_windows(docs, size):
    out = []
    for t in docs:
        if t:
            out += [set(t[i : i + size]) for i in range(max(1, len(t) - size + 1))]
    return out


def test_window_coherence(spark):
    rng = np.random.default_rng(3)
    docs = [list(rng.choice(list("abcdefxyz"), rng.integers(1, 30))) for _ in range(40)] + [[], ["a"]]
    df = spark.createDataFrame([(i, [str(x) for x in d]) for i, d in enumerate(docs)], "d int, t array<string>")
    tops = {0: ["a", "b", "c"], 1: ["d", "q", "e", "a"]}
    top = spark.createDataFrame([(t, w, r + 1) for t, ws in tops.items() for r, w in enumerate(ws)], "topic int, term string, rank int")
    windows = brute_windows(docs, 6)
    pairs, n = ev.window_pairs(top, df, "d", "t", 6)
    assert n == len(windows)
    count = lambda *w: sum(set(w) <= s for s in windows)
    for r in pairs.collect():
        assert (r.df_a, r.df_b, r.df_ab) == (count(r.a), count(r.b), count(r.a, r.b))
    got = {r.topic: r.coherence for r in ev.c_v(pairs, n).collect()}
    for topic, ws in tops.items():
        m = np.zeros((len(ws), len(ws)))
        for i, j in itertools.product(range(len(ws)), repeat=2):
            p, a, b = count(ws[i], ws[j]) / n + 1e-12, count(ws[i]) / n, count(ws[j]) / n
            m[i, j] = math.log(p / (a * b)) / -math.log(p) if a and b else 0
        total = m.sum(axis=0)
        cos = [v @ total / np.linalg.norm(v) / np.linalg.norm(total) if np.linalg.norm(v) else 0 for v in m]
        assert got[topic] == pytest.approx(np.mean(cos), abs=1e-6)
    theta = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 1.0)], "d int, topic int, p double")
    row = ev.evaluation(top, theta, "d", ev.c_v(pairs, n), 12.5).first()
    assert row.perplexity == 12.5 and row.mean_entropy == pytest.approx(math.log(2) / 2) and row.diversity == pytest.approx(6 / 7) and row.silhouette == 0


def test_paths_and_new_points():
    x = np.array([[0, 0], [1, 0.1], [2, 3.0], [3, 0.1], [4, 0], [2, 0.2]], float)
    # 2 lies off the way; 5 is the point nearest the middle of 1 and 3
    assert mf.refined_path(x, [0, 1, 2, 3, 4]) == [0, 1, 5, 3, 4]
    # no point lies within the radius, so nothing is replaced
    assert mf.refined_path(np.array([[0, 0], [5, 9], [1, 0]], float), [0, 1, 2], 0.4) == [0, 1, 2]
    # the neighbours lie half their distance from the middle
    assert mf.refined_path(np.array([[0, 0], [5, 9], [1, 0]], float), [0, 1, 2]) == [0, 0, 2]
    grid = np.array([[i, j, k] for i in range(5) for j in range(3) for k in range(2)], float)
    path = mf.smooth_path(grid, n=5)
    assert [tuple(grid[i]) for i in path] == [(i, 2, 1) for i in range(5)]
    low = mf.smooth_path(grid, n=5, second_method="percentile", second_range=(0, 40), third_method="min")
    assert all(grid[i][1] <= 1 and grid[i][2] == 0 for i in low) and len(low) == 5
    coords = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    new = mf.placed_points(np.array([[0.0, 1.0, 1.0], [0.5, 0.5, 9.0]]), coords, knn=2)
    assert np.allclose(new[0], coords[0], atol=1e-6) and np.allclose(new[1], [0.5, 0], atol=1e-3)
    with pytest.raises(ValueError):
        mf.placed_points(np.zeros((1, 0)), np.zeros((0, 2)))


def test_distances_between_two_sets(spark):
    one = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "c", 1.0)], "topic int, term string, p double")
    two = spark.createDataFrame([(7, "a", 2.0), (7, "b", 2.0), (8, "z", 1.0)], "topic int, term string, p double")
    got = {(r.i, r.j): r.distance for r in mf.hellinger_between(one, two).collect()}
    assert got == pytest.approx({(0, 7): math.sqrt(1 - math.sqrt(0.125) - math.sqrt(0.375))})


def test_helpers(spark):
    df = spark.createDataFrame([(0, 3), (2, 1), (None, 1)], "c int, t int")
    index = df.select(co.chunk_topic_index("c", "t", 4, 3).alias("i"))
    assert [r.i for r in index.collect()] == [3, 9, None]
    assert index.where("i IS NOT NULL").select(*co.split_topic_index("i", 4)).collect() == [(0, 3), (2, 1)]
    with pytest.raises(Exception):
        df.select(co.chunk_topic_index("c", "t", 2)).collect()
    assert [co.catalan(n) for n in range(6)] == [1, 1, 2, 5, 14, 42]
    m = spark.sql("SELECT map('a', 1, 'b', 2, 'c', 2) AS m, array(3, 1, 1) AS x, array(1, 2, 3) AS y, 'p, q,,r,' AS s, 1 AS k")
    row = m.select(co.first_key("m", 2).alias("f"), co.first_key("m", 9).alias("g"), co.common_values("x", "y").alias("z")).first()
    assert (row.f, row.g, row.z) == ("b", None, [1, 3])
    assert [r.part for r in co.split_lists(m, "s", "part", ["k"]).collect()] == ["p", "q", "r"]
    rows = spark.createDataFrame([(i, [i % 3, None]) for i in range(9)], "i int, v array<int>")
    assert sorted(r.value for r in co.merged_values(rows, "v").collect()) == [0, 1, 2] and co.count_unique(rows, "v", [1, 2]).first().n == 2
    assert co.nth_row(rows, ["i"], -2).first().i == 7
    with pytest.raises(IndexError):
        co.nth_row(rows, ["i"], 9)
    assert co.check_name("a_1") == "a_1"
    with pytest.raises(ValueError):
        co.check_name("1a")
    assert [r.n for r in co.histogram(rows, "i", 0, 8, 4).orderBy("bin").collect()] == [2, 2, 2, 3]
    other = spark.createDataFrame([(1.5,), (100.0,)], "b double")
    assert sorted(r.i for r in co.band_join(rows, other, "i", "b", 1.0).collect()) == [1, 2]
    with pytest.raises(ValueError):
        co.band_join(rows, other, "i", "b", 0)
    assert rows.select(F.count_distinct("i")).first()[0] == 9
