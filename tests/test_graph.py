"""Graph operators on small graphs with known answers."""

import pytest

from folioscope.operators import graph as gr


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs] or [], "src bigint, dst bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_from_papers(spark):
    p = spark.createDataFrame([(1, [3, 1, None, 1]), (2, [1, 3, 2]), (3, None), (4, []), (5, [9])], "paper_id bigint, author_ids array<bigint>")
    assert rows(gr.coauthor_edges(p)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert rows(gr.coauthor_edges(p, least=2)) == [(1, 3, 2)]
    assert rows(gr.multigraph_edges(p)) == [(1, 2), (1, 3), (1, 3), (1, 3), (2, 3)]
    assert rows(gr.doc_authors(p).where("paper_id = 1")) == [(1, 1, 2), (1, 3, 2)]
    assert gr.coauthor_edges(p.limit(0)).count() == 0


def test_triangle(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    assert rows(gr.triangles(e)) == [(1, 1), (2, 1), (3, 1)]
    assert {r.id: round(r.clustering, 4) for r in gr.clustering(e).collect()} == {1: 1.0, 2: 1.0, 3: 0.3333, 4: 0.0}
    assert rows(gr.neighbours(e, 3)) == [(1,), (2,), (4,)]
    assert rows(gr.limit_degrees(e, 2)) == [(1, 2), (1, 3), (2, 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102)]
    labels = gr.components(edges(spark, chain), spark.createDataFrame([(500,)], "id bigint"))
    assert {r.component for r in labels.collect()} == {1, 100, 500}
    assert rows(gr.component_sizes(labels)) == [(1, 40, 0), (100, 3, 1), (500, 1, 2)]
    assert rows(gr.kth_component(labels, 1)) == [(100,), (101,), (102,)]
    assert {r.component: r.density for r in gr.component_density(edges(spark, chain), labels).collect()}[500] == 0.0


def test_propagation_and_hops(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (8, 9)])
    fixed = spark.createDataFrame([(1, 10), (5, 20)], "id bigint, label bigint")
    got = dict(rows(gr.propagate_labels(e, fixed)))
    assert got == {1: 10, 2: 10, 3: 10, 4: 10, 5: 20}  # ties go to the smaller label, the fixed ones stay
    hops = gr.hop_distances(e, spark.createDataFrame([(1,)], "source bigint"))
    assert rows(hops) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4)]


def test_alternating_labels_end(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (1, 9), (4, 8)])
    got = dict(rows(gr.propagate_labels(e, spark.createDataFrame([(9, 1), (8, 2)], "id bigint, label bigint"))))
    assert set(got) == {1, 2, 3, 4, 8, 9}


def test_scores(spark):
    p, tr, te = edges(spark, [(1, 2), (1, 3), (2, 4)]), edges(spark, [(1, 2)]), edges(spark, [(1, 3), (5, 6)])
    r = gr.link_scores(p, tr, te).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1) and abs(r.precision - 1 / 3) < 1e-12 and r.recall == 0.5
    lab = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    ari, nmi = gr.agreement(lab, "a", "b").first()
    assert abs(ari - 0.5714285714) < 1e-9 and 0 < nmi < 1
    assert gr.agreement(lab, "a", "a").first()[0] == 1.0


def test_louvain_two_cliques(spark):
    a = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    b = [(i + 10, j + 10) for i, j in a]
    got = dict(rows(gr.louvain(edges(spark, a + b + [(0, 10)]))))
    assert len({got[i] for i in range(5)}) == 1 and len({got[i + 10] for i in range(5)}) == 1 and got[0] != got[10]
    assert len({c for _, c in rows(gr.louvain(edges(spark, a), driver_links=2))}) == 1
