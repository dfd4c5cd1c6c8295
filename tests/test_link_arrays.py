"""Graphs over arrays against joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions import vectors as vec
from folioscope.operators import graph as gr
from folioscope.operators import interpretation as it
from folioscope.operators import link_arrays as la


def some_links(spark, n, m, seed, hub=True):
    rng = random.Random(seed)
    rows = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | ({(0, i) for i in range(1, n, 3)} if hub else set())
    chain = [(10**10 + i, 10**10 + i + 1) for i in range(9)]
    return spark.createDataFrame(sorted(rows) + chain, "src bigint, dst bigint")


def test_hash_is_that_of_the_engine(spark):
    ids = np.array([0, 1, -5, 2**40, -(2**63), 2**63 - 1], np.int64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "i int, x bigint")
    want = [r.h for r in df.select("i", F.xxhash64(F.lit(77).cast("bigint"), "x", F.lit(-3)).alias("h")).orderBy("i").collect()]
    assert la.hash_of(np.array([77]), ids, -3).tolist() == want


def test_distances_by_path_length_over_arrays(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 64)
    monkeypatch.setattr(gr, "TOGETHER", 5)
    e = some_links(spark, 150, 120, 1)
    ids = [i for i in range(150) if i % 4] + [10**10 + i for i in range(10) if i != 4]
    v = spark.createDataFrame([(i, [1.0 + i % 7, 2.0]) for i in ids], "id bigint, v array<double>")
    sources = spark.createDataFrame([(i,) for i in [*range(1, 24), 10**10, 10**10 + 4, 5 * 10**9]], "source bigint")
    got = sorted(map(tuple, gr.distance_by_path_length(e, sources, v, vec.hellinger).collect()))
    want = sorted(map(tuple, gr.distance_by_hops(gr.hop_distances(e, sources), v, vec.hellinger).collect()))
    assert got == want and len(got) > 60
    assert sorted(map(tuple, gr.distance_by_path_length(e, sources, v, vec.hellinger, array_links=3).collect())) == want
    assert gr.distance_by_path_length(e.limit(0), sources, v, vec.hellinger).count() == 0


def test_hops_over_arrays(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 16)
    monkeypatch.setattr(la, "TRIES", 2)
    e = some_links(spark, 90, 150, 2)
    names, begin, near = la.link_arrays(e, hubs_first=True)
    want = {(r.source, r.id): r.hops for r in gr.hop_distances(e, e.select("src").distinct().select(F.col("src").alias("source"))).collect()}
    for source in {s for s, _ in want}:
        hops = la.hops_from(int(np.flatnonzero(names == source)[0]), begin, near, np.ones(len(near), bool), np.diff(begin))
        assert {(source, int(i)): int(h) for i, h in zip(names, hops) if h >= 0} == {k: h for k, h in want.items() if k[0] == source}


def test_longest_paths_are_of_farthest_vertices(spark):
    """Every path against a plain search over the links that are left."""
    e = some_links(spark, 60, 90, 3)
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    found = it._paths_on_arrays(e, 10**6, 4)
    assert len(found) == e.count()
    at = 0
    while at < len(found):
        source, path = found[at][0], [found[at][0]]
        while at < len(found) and found[at][0] == source and found[at][2] == len(path):
            path.append(found[at][1])
            at += 1
        hops, front = {source: 0}, [source]
        while front:
            front = [u for v in front for u in near[v] if hops.setdefault(u, hops[v] + 1) == hops[v] + 1 and u not in front]
            front = list(dict.fromkeys(front))
        assert hops[path[-1]] == max(hops.values()) == len(path) - 1
        for a, b in zip(path, path[1:]):
            near[a].remove(b)
            near[b].remove(a)


def test_communities_over_arrays_are_those_of_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 100)
    monkeypatch.setattr(gr, "MOVES", 3)
    e = some_links(spark, 120, 200, 5)
    pairs = gr.both_ways(e)
    names, begin, near = la.link_arrays(e)
    want = {r.v: r.c for r in gr._moved(pairs.select("a", "b", F.lit(1.0).alias("w")), 1.0).collect()}
    own = la.moved_on_arrays(names, begin, near, np.ones(len(near)), 1.0, gr.MOVES)
    assert dict(zip(names.tolist(), names[own].tolist())) == want
    got = {r.id: r.community for r in gr.louvain(e, driver_links=150, array_links=1_000).collect()}
    assert set(got) == set(want) and len(set(got.values())) < 40 and len({got[10**10 + i] for i in range(10)} & {got[i] for i in range(10)}) == 0
