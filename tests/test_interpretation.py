"""Reading topics: filters, author terms, representatives, trajectories, paths."""

import numpy as np
import pytest

from folioscope.functions import vectors as vec
from folioscope.operators import interpretation as it


def phi(spark):
    rows = [(0, "a", 0.6), (0, "b", 0.3), (0, "c", 0.1), (1, "a", 0.1), (1, "b", 0.1), (1, "d", 0.8)]
    return spark.createDataFrame(rows, "topic int, term string, p double")


def test_filtered_topics(spark):
    hot = {(r.topic, r.term): round(r.p, 6) for r in it.filtered_topics(phi(spark), 1, 1.0).collect()}
    assert hot == {(0, "a"): 1.0, (1, "d"): 1.0}
    mask = {(r.topic, r.term): round(r.p, 6) for r in it.filtered_topics(phi(spark), 1, 1.0, it.VOCAB_MASK).collect()}
    assert mask == {(0, "a"): 1.0, (1, "a"): round(1 / 9, 6), (1, "d"): round(8 / 9, 6)}
    with pytest.raises(ValueError):
        it.filtered_topics(phi(spark), 1, 1.0, "other")


def test_author_terms(spark):
    authors = spark.createDataFrame([(7, 0, 0.5), (7, 1, 0.5)], "author_id bigint, topic int, p double")
    got = {r.term: round(r.p, 6) for r in it.author_term_distribution(authors, phi(spark)).collect()}
    assert got == {"a": 0.35, "b": 0.2, "c": 0.05, "d": 0.4}


def test_representatives():
    x = np.array([[0, 0], [0, 1], [0.2, 0.4], [5, 5], [5, 6.0]])
    got = it.representatives(x, [1, 1, 1, 2, 2], spread=0.0)
    assert got[1] == 2 and got[2] in (3, 4)


def test_trajectory(spark):
    knn = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "i int, j int, distance double")
    assert it.trajectory(knn, 1, 3) == (2.0, [1, 2, 3]) and it.trajectory(knn, 3, 1)[1] == [3, 2, 1] and it.trajectory(knn, 1, 9)[1] == []


@pytest.mark.parametrize("driver_links", [1_000, 2])
def test_paths_that_share_no_link(spark, driver_links):
    links = [(1, 2), (2, 3), (3, 4), (1, 5), (3, 1), (8, 9), (5, 5)]
    e = spark.createDataFrame(links + [(2, 1)], "src bigint, dst bigint")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 10)], "id bigint, v array<double>")
    got = it.disjoint_longest_paths(e, v, vec.euclidean, driver_links=driver_links).collect()
    # every link is used by one step of one path
    assert len(got) == 6 and all(r.distance == abs(r.source - r.id) for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, []).append(r.hops)
    assert max(r.hops for r in got) >= 2 and all(1 in h for h in per.values())
    assert len(it.disjoint_longest_paths(e, v, vec.euclidean, 2, driver_links=driver_links).collect()) == 2
    again = it.disjoint_longest_paths(e, v, vec.euclidean, driver_links=driver_links).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert it.disjoint_longest_paths(e.limit(0), v, vec.euclidean).count() == 0


def test_cluster_summary(spark):
    c = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "topic int, cluster int")
    p = spark.createDataFrame([(0, [0.0, 2.0]), (1, [2.0, 2.0]), (2, [5.0, 5.0])], "topic int, v array<double>")
    assert {r.cluster: (r.size, r.centroid, r.spread) for r in it.cluster_summary(c, p).collect()} == {1: (2, [1.0, 2.0], 0.5), 2: (1, [5.0, 5.0], 0.0)}
