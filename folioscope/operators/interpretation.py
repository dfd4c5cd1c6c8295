"""Reading fitted topics: filtered topics, author embeddings in term space, cluster words, representatives, trajectories."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.link_arrays import ARRAY_LINKS, hops_from, link_arrays
from folioscope.operators.vocabulary import relevance, top_terms
from folioscope.session import checkpointed

# The two ways to filter topics by their most relevant terms.
N_HOT, VOCAB_MASK = "n_hot", "vocab_mask"


def filtered_topics(phi: DataFrame, n: int = 100, lam: float = 0.6, how: str = N_HOT, digits: int = 9) -> DataFrame:
    """(topic, term, p): ``n_hot`` keeps each topic's own n most relevant terms, ``vocab_mask`` keeps in every topic the
    terms that are relevant for any; each topic is divided by its sum. Relevance is compared to ``digits`` places, ties by
    term."""
    if how not in (N_HOT, VOCAB_MASK):
        raise ValueError(f"unknown filter {how!r}")
    scores = relevance(phi.select("topic", "term", F.col("p").alias("weight")), lam)
    best = top_terms(scores.withColumn("relevance", F.round("relevance", digits)), n).select("topic", "term")
    on = ["topic", "term"] if how == N_HOT else ["term"]
    kept = phi.join(best if how == N_HOT else best.select("term").distinct(), on, "left_semi")
    return kept.select("topic", "term", (F.col("p") / F.sum("p").over(Window.partitionBy("topic"))).alias("p"))


def author_term_distribution(author_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """(author_id, term, p): an author's topics spread over (filtered) topics' terms, divided by the sum."""
    met = author_topic.select("author_id", "topic", F.col("p").alias("a")).join(topics.select("topic", "term", F.col("p").alias("b")), "topic")
    s = met.groupBy("author_id", "term").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    return s.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("author_id")))


def cluster_words(phi: DataFrame, clusters: DataFrame, n: int = 40, digits: int = 9) -> DataFrame:
    """(cluster, term, p, rank): mean probability of a term over the topics of a cluster that have it, to ``digits`` places,
    the n best, ties by term."""
    mean = phi.join(clusters, "topic").where("p > 0").groupBy("cluster", "term").agg(F.round(F.avg("p"), digits).alias("p"))
    return top_terms(mean, n, "p", "cluster")


def word_counts(df: DataFrame, tokens: str, n: int = 200) -> DataFrame:
    """(term, n) of the most frequent terms of a collection, ties by term."""
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def cluster_summary(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster, size, centroid, spread): element-wise mean and mean variance of the coordinates (topic, v)."""
    long_ = clusters.join(points, "topic").select("cluster", "topic", F.posexplode("v").alias("pos", "x"))
    per = long_.groupBy("cluster", "pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count(F.lit(1)).alias("size"))
    return per.groupBy("cluster").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"), F.avg("s").alias("spread")).select("cluster", "size", F.col("c.m").alias("centroid"), "spread")


def representatives(coords: np.ndarray, clusters: list[int], rounds: int = 100, spread: float = 0.25) -> dict[int, int]:
    """{cluster: index}: one point per cluster, far from the other representatives (weight ``spread``) and near its own
    centroid (the rest), improved in turn until nothing changes. Coordinates of topics, so few."""
    members: dict[int, list[int]] = {}
    for i, c in enumerate(clusters):
        members.setdefault(c, []).append(i)
    centre = {c: coords[m].mean(axis=0) for c, m in members.items()}
    chosen = {c: min(m, key=lambda i: (np.linalg.norm(coords[i] - centre[c]), i)) for c, m in members.items()}
    for _ in range(rounds):
        changed = False
        for c in sorted(members):
            others = [coords[i] for k, i in chosen.items() if k != c]
            score = lambda i: spread * sum(np.linalg.norm(coords[i] - o) for o in others) - (1 - spread) * np.linalg.norm(coords[i] - centre[c])  # noqa: B023, E731
            best = max(members[c], key=lambda i: (score(i), -i))
            if best != chosen[c]:
                chosen[c], changed = best, True
        if not changed:
            break
    return chosen


def trajectory(knn: DataFrame, start: int, end: int, driver_edges: int = 1_000_000) -> tuple[float, list[int]]:
    """(length, topics) of the shortest path between two topics over neighbour distances (i, j, distance), both ways; (inf,
    []) if there is none. Up to ``driver_edges`` rows the heap on the driver finds it, beyond them rounds of joins do."""
    both = knn.select("i", "j", "distance").unionByName(knn.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    links = both.groupBy("i", "j").agg(F.min("distance").alias("distance"))
    rows = links.limit(2 * driver_edges + 1).collect()
    if len(rows) > 2 * driver_edges:
        return _relaxed(links, start, end)
    near: dict[int, list[tuple[int, float]]] = {}
    for i, j, d in rows:
        near.setdefault(i, []).append((j, d))
    best, come, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        length, v = heapq.heappop(heap)
        if v == end:
            path = [v]
            while path[-1] in come:
                path.append(come[path[-1]])
            return length, path[::-1]
        if length > best[v]:
            continue
        for u, d in near.get(v, ()):
            if length + d < best.get(u, math.inf):
                best[u], come[u] = length + d, v
                heapq.heappush(heap, (length + d, u))
    return math.inf, []


def _relaxed(links: DataFrame, start: int, end: int) -> tuple[float, list[int]]:
    """Shortest path by rounds: every topic whose length fell offers its neighbours a path; no longer path than the best
    one to ``end`` is followed."""
    kind = dict(links.dtypes)["i"]
    links = checkpointed(links)
    best = front = checkpointed(links.sparkSession.createDataFrame([(start, 0.0, [start])], f"v {kind}, length double, path array<{kind}>"))
    limit = 0.0 if start == end else math.inf
    while True:
        offered = front.join(links, front["v"] == links["i"]).select(F.col("j").alias("v"), (F.col("length") + F.col("distance")).alias("length"), F.concat("path", F.array("j")).alias("path"))
        offered = offered.where(F.col("length") < limit).groupBy("v").agg(F.min_by("path", "length").alias("path"), F.min("length").alias("length"))
        old = best.select("v", F.col("length").alias("old"))
        front = checkpointed(offered.join(old, "v", "left").where("old IS NULL OR length < old").select("v", "length", "path"))
        if front.limit(1).count() == 0:
            break
        best = checkpointed(best.join(front.select("v"), "v", "left_anti").unionByName(front))
        done = best.where(F.col("v") == end).select("length").first()
        limit = done[0] if done else limit
    found = best.where(F.col("v") == end).first()
    return (found["length"], list(found["path"])) if found else (math.inf, [])


def disjoint_longest_paths(edges: DataFrame, vectors: DataFrame, metric, samples: int = 10_000, seed: int = 0, driver_links: int = ARRAY_LINKS) -> DataFrame:
    """(source, id, hops, distance) along long shortest paths that share no link: from a vertex drawn by a seeded generator
    a shortest path to one of the farthest vertices is taken, the vertices on it are paired with its source, and its
    links are removed; again until ``samples`` pairs are found or no link is left. ``vectors``: id, v; pairs without both
    vectors give no row.

    One path hangs on those before it, so they follow one another; up to ``driver_links`` links each is found on sorted
    arrays in the driver, beyond them by joins (see ``graph.hop_distances``)."""
    spark = edges.sparkSession
    pairs = checkpointed(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    found = _paths_on_arrays(pairs, samples, seed) if pairs.count() <= driver_links else _paths_by_joins(pairs, samples, seed)
    rows = spark.createDataFrame(found, "source bigint, id bigint, hops int")
    known = rows.join(vectors.select("id", "v"), "id").join(vectors.select(F.col("id").alias("source"), F.col("v").alias("sv")), "source")
    return known.select("source", "id", "hops", metric("sv", "v").alias("distance"))


def _paths_on_arrays(pairs: DataFrame, samples: int, seed: int) -> list[tuple[int, int, int]]:
    names, begin, near = link_arrays(pairs, hubs_first=True)
    open_ = np.argsort(names)
    alive, degree = np.ones(len(near), bool), np.diff(begin)
    rng = np.random.default_rng(seed)
    out: list[tuple[int, int, int]] = []
    while len(out) < samples and len(open_):
        source = int(rng.choice(open_))
        hops = hops_from(source, begin, near, alive, degree)
        last = np.flatnonzero(hops == hops.max())
        v = int(rng.choice(last[np.argsort(names[last])]))
        path = []
        while v != source:
            path.append(v)
            places = np.arange(begin[v], begin[v + 1])
            places = places[alive[places] & (hops[near[places]] == hops[v] - 1)]
            at = places[np.argmin(names[near[places]])]
            u = int(near[at])
            back = begin[u] + np.searchsorted(near[begin[u] : begin[u + 1]], v)
            alive[at] = alive[back] = False
            degree[u] -= 1
            degree[v] -= 1
            v = u
        if (degree[[source, *path]] == 0).any():  # a vertex without links left would only find itself
            open_ = open_[degree[open_] > 0]
        out += [(int(names[source]), int(names[x]), n + 1) for n, x in enumerate(path[::-1])]
    return out[:samples]


def _paths_by_joins(pairs: DataFrame, samples: int, seed: int) -> list[tuple[int, int, int]]:
    from folioscope.operators.graph import both_ways, hop_distances

    spark = pairs.sparkSession
    out: list[tuple[int, int, int]] = []
    turn = 0
    while len(out) < samples:
        first = pairs.orderBy(F.xxhash64("src", "dst", F.lit(seed), F.lit(turn))).first()
        if first is None:
            break
        source = first["src"]
        hops = hop_distances(pairs, spark.createDataFrame([(source,)], "source bigint"))
        far = hops.orderBy(F.desc("hops"), F.xxhash64("id", F.lit(turn)), "id").first()
        path, links = [far["id"]], both_ways(pairs)
        for hop in range(far["hops"] - 1, -1, -1):  # one row a hop
            back = links.where(F.col("a") == path[-1]).join(hops.where(F.col("hops") == hop).select(F.col("id").alias("b")), "b").agg(F.min("b")).first()
            path.append(back[0])
        path = path[::-1]
        out += [(source, v, i + 1) for i, v in enumerate(path[1:])]
        gone = spark.createDataFrame([(min(x), max(x)) for x in zip(path, path[1:])], "src bigint, dst bigint")
        pairs = checkpointed(pairs.join(F.broadcast(gone), ["src", "dst"], "left_anti"))  # as many rows as the path has links
        turn += 1
    return out[:samples]
