"""Queries on small tables against brute force: no link, author, topic or hop is left out."""

import datetime as dt

import pytest

from folioscope.operators import graph as gr
from folioscope.operators import topic_models as tp
from folioscope.plans.reference_queries import QUERIES

# most links occur in one paper only; 1 to 12 is a chain with a shortcut-free tail, 20 to 22 a triangle, 30 and 31 a pair seen twice
GROUPS = [[i, i + 1] for i in range(1, 12)] + [[20, 21, 22], [30, 31], [31, 30], [40]]
AT = dt.datetime(2020, 1, 1)


def brute_components(groups):
    label = {v: v for g in groups if len(g) > 1 for v in g}
    while True:
        new = dict(label)
        for g in groups:
            if len(g) > 1:
                low = min(new[v] for v in g)
                new.update({v: low for v in g})
        if new == label:
            return label
        label = new


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, dt.date(2001 + i, 1, 1), g, ["term"], ["c"], AT) for i, g in enumerate(GROUPS)]
    spark.createDataFrame(rows, "paper_id bigint, date date, author_ids array<bigint>, preprocessed_text array<string>, categories array<string>, ingested_at timestamp").write.parquet(f"{d}/papers.parquet")
    # authors 3, 7, 20 and 31 have a distribution; none of their ids is divisible by 10 but 20
    dist = [(a, [float(t == topic) for t in range(64)], AT) for a, topic in ((3, 5), (7, 6), (20, 1), (31, 2))]
    spark.createDataFrame(dist, "author_id bigint, author_topic_space_probs array<double>, computed_at timestamp").write.parquet(f"{d}/author_topics.parquet")
    return d


def test_components_take_every_link(spark, tables):
    want = brute_components(GROUPS)
    assert {r.id: r.component for r in QUERIES["connected_components"](spark, tables).collect()} == want
    assert sorted((r.component, r["size"], r["rank"]) for r in QUERIES["component_ranking"](spark, tables).collect()) == [(1, 12, 0), (20, 3, 1), (30, 2, 2)]
    assert {r.component: (r.vertices, r.edges, r.density) for r in QUERIES["component_densities"](spark, tables).collect()} == {1: (12, 11, 0.1667), 20: (3, 3, 1.0), 30: (2, 1, 1.0)}


def test_louvain_places_every_linked_author(spark, tables):
    got = {r.id: r.community for r in QUERIES["louvain_communities"](spark, tables).collect()}
    assert set(got) == set(brute_components(GROUPS)) and len({got[v] for v in (20, 21, 22)}) == 1


def test_distances_follow_links_seen_once(spark, tables):
    got = QUERIES["distance_by_path_length"](spark, tables).collect()
    assert {3, 7} <= {r.source for r in got} and {r.hops for r in got if r.source == 3} == {4}


def test_labels_start_from_every_distribution(spark, tables):
    got = {r.id: r.label for r in QUERIES["label_propagation"](spark, tables).collect()}
    # ties go to the smaller label: 5 between 4 and 6, then 6 between 5 and the fixed 7
    want = {**{v: 5 for v in range(1, 7)}, **{v: 6 for v in range(7, 13)}, 20: 1, 21: 1, 22: 1, 30: 2, 31: 2}
    assert got == want


def test_rank_correlation_of_all_authors(spark, tables):
    near, docs = {}, {}
    for g in GROUPS:
        for v in set(g):
            docs[v] = docs.get(v, 0) + 1
            near.setdefault(v, set()).update(set(g) - {v})
    pairs = [(len(near[v]), docs[v]) for v in near if near[v]]
    sign = lambda x: (x > 0) - (x < 0)
    s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a in pairs for b in pairs]
    tau = sum(x * y for x, y in s) / (sum(x * x for x, _ in s) * sum(y * y for _, y in s)) ** 0.5
    assert abs(QUERIES["rank_correlation"](spark, tables).first().tau - tau) < 1e-4


def test_hops_end_with_the_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(23)], "src bigint, dst bigint")
    hops = gr.hop_distances(e, spark.createDataFrame([(0,)], "source bigint"))
    assert {r.id: r.hops for r in hops.collect()} == {i: i for i in range(24)}


def test_every_term_is_in_the_vocabulary(spark):
    docs = spark.range(300).selectExpr("id AS d", "transform(sequence(id * 1000, id * 1000 + 999), x -> cast(x AS string)) AS t")
    assert len(tp.fit_topics(docs, "t", 2, rounds=1).words.vocabulary) == 300_000
