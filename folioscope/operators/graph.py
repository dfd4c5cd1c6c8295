"""Co-author graphs as edge tables, and graph analytics as joins and aggregates.

An undirected edge is a row (src, dst) with src < dst. Loops that iterate cut their lineage with checkpoints in
the shared folder and stop with an error rather than with a partial result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.link_arrays import ARRAY_LINKS, contracted, link_arrays, moved_on_arrays, one_of_each_hop
from folioscope.operators.numbering import numbered
from folioscope.session import checkpointed

MAX_ROUNDS = 60


def doc_authors(papers: DataFrame, doc: str = "paper_id", authors: str = "author_ids", keep: list[str] | None = None) -> DataFrame:
    """(doc, keep..., author_id, n_authors): each non-null author once per document."""
    ids = F.array_distinct(F.array_compact(F.col(authors)))
    return papers.select(doc, *(keep or []), F.explode(ids).alias("author_id"), F.size(ids).cast("bigint").alias("n_authors"))


def _pairs(papers: DataFrame, authors: str, keep: list[str], once: bool) -> DataFrame:
    ids = F.array_compact(F.col(authors))
    ids = F.array_sort(F.array_distinct(ids) if once else ids)
    rest = papers.select(*keep, ids.alias("ids")).where(F.size("ids") > 1)
    # each author with those that follow it in the sorted list: every pair of the document once
    left = rest.select(*keep, "ids", F.posexplode("ids").alias("p", "src"))
    right = left.select(*keep, "src", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("dst"))
    return right.where("src < dst")


def coauthor_edges(papers: DataFrame, authors: str = "author_ids", by: list[str] | None = None, least: int = 1) -> DataFrame:
    """(by..., src, dst, cnt): documents that two authors share, per value of ``by``, where at least ``least``."""
    pairs = _pairs(papers, authors, by or [], True)
    edges = pairs.groupBy(*(by or []), "src", "dst").agg(F.count(F.lit(1)).alias("cnt"))
    return edges.where(F.col("cnt") >= least) if least > 1 else edges


def multigraph_edges(papers: DataFrame, authors: str = "author_ids", by: list[str] | None = None) -> DataFrame:
    """(by..., src, dst): one row for each time a pair occurs, repeats within a list counted."""
    return _pairs(papers, authors, by or [], False)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over distinct neighbours."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def limit_degrees(edges: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Edges whose both ends have a degree within the limits; one pass, degrees are not taken again."""
    kept = degrees(edges)
    if least is not None:
        kept = kept.where(F.col("degree") >= least)
    if most is not None:
        kept = kept.where(F.col("degree") <= most)
    columns = edges.columns
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return edges.select(*columns)


def compose(edges: DataFrame, first: int, last: int, least: int | None = None, most: int | None = None, by: str = "year") -> DataFrame:
    """(src, dst): union of the graphs of ``first`` to ``last``, then the degree limits."""
    return limit_degrees(edges.where(F.col(by).between(first, last)).select("src", "dst").distinct(), least, most)


def neighbours(edges: DataFrame, author: int) -> DataFrame:
    """(coauthor) of one author."""
    mine = edges.where((F.col("src") == author) | (F.col("dst") == author))
    return mine.select(F.when(F.col("src") == author, F.col("dst")).otherwise(F.col("src")).alias("coauthor")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, each once."""
    e = edges.select("src", "dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def two_hop_pairs(edges: DataFrame, hub: int = 100) -> DataFrame:
    """(src, dst) that are not linked but share a co-author with at most ``hub`` links, each once: candidates for new links.
    What two people have in common through somebody whom everybody knows says little, and its pairs would grow with the
    square of the links; ``hub`` is part of what a candidate is."""
    pairs = checkpointed(both_ways(edges))
    low = pairs.join(degrees(edges).where(F.col("degree") <= hub).select(F.col("id").alias("a")), "a", "left_semi")
    met = low.select("a", F.col("b").alias("src")).join(low.select("a", F.col("b").alias("dst")), "a").where("src < dst").select("src", "dst").distinct()
    return met.join(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_anti")


def hyperedges(papers: DataFrame, doc: str = "paper_id", authors: str = "author_ids") -> DataFrame:
    """(doc, members, size): the sorted authors of each document that has any."""
    ids = F.array_sort(F.array_distinct(F.array_compact(F.col(authors))))
    return papers.select(doc, ids.alias("members"), F.size(ids).cast("bigint").alias("size")).where("size > 0")


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles). Edges point from the lower to the higher degree, so no vertex has many successors and the
    join of successor pairs stays small even around hubs."""
    deg = degrees(edges)
    e = edges.select("src", "dst").distinct()
    e = e.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = e.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w"))
    found = wedge.join(closed, ["v", "w"])
    return found.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering): closed share of an author's pairs of co-authors; 0 below degree 2."""
    both = degrees(edges).join(triangles(edges), "id", "left").fillna(0, ["triangles"])
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return both.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / possible).otherwise(0.0))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """(id, neighbour_degree): mean degree of the neighbours."""
    deg = degrees(edges).select(F.col("id").alias("b"), "degree")
    return both_ways(edges).join(deg, "b").groupBy(F.col("a").alias("id")).agg(F.avg("degree").alias("neighbour_degree"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """One row ``assortativity``: correlation of the degrees at the two ends of an edge, both directions."""
    deg = degrees(edges)
    ends = both_ways(edges).join(deg.select(F.col("id").alias("a"), F.col("degree").alias("x")), "a").join(deg.select(F.col("id").alias("b"), F.col("degree").alias("y")), "b")
    return ends.agg(F.corr("x", "y").alias("assortativity"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that is connected; ``nodes`` (id) adds isolated ones. Labels travel to
    neighbours and jump to the label of their label each round, so long chains shorten geometrically."""
    pairs = checkpointed(both_ways(edges))
    ids = pairs.select(F.col("a").alias("id")).distinct()
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id")).distinct()
    labels = checkpointed(ids.select("id", F.col("id").alias("component")))
    for _ in range(MAX_ROUNDS):
        near = pairs.join(labels, pairs["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        step = checkpointed(step.join(jump, "next", "left").select("id", "component", F.least("next", F.coalesce("jump", "next")).alias("next")))
        if step.where("next < component").limit(1).count() == 0:
            return labels
        labels = step.select("id", F.col("next").alias("component"))
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, size, rank): rank 0 is the largest; ties by the smaller label."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return numbered(sizes, [F.desc("size"), "component"], "rank")


def kth_component(labels: DataFrame, k: int = 0) -> DataFrame:
    """(id) of the k-th largest component, from 0."""
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(k + 1)
    chosen = best.orderBy("size", F.desc("component")).limit(1) if k else best
    return labels.join(F.broadcast(chosen.select("component")), "component", "left_semi").select("id")


def component_density(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, vertices, edges, density): 2E / (V (V - 1)); 0 for a single vertex."""
    v = labels.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))
    e = edges.select("src", "dst").distinct().join(labels.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    both = v.join(e, "component", "left").fillna(0, ["edges"])
    return both.withColumn("density", F.when(F.col("vertices") > 1, 2 * F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(0.0))


def documents_of(papers: DataFrame, authors: DataFrame, doc: str = "paper_id", by: str = "author_ids") -> DataFrame:
    """Documents with at least one of the authors (column author_id)."""
    wanted = doc_authors(papers, doc, by).join(authors.select("author_id"), "author_id", "left_semi").select(doc).distinct()
    return papers.join(wanted, doc, "left_semi")


def documents_within(papers: DataFrame, edges: DataFrame, authors: DataFrame, doc: str = "paper_id", by: str = "author_ids") -> tuple[DataFrame, DataFrame]:
    """(papers, edges) of chosen authors (column author_id): documents with at least one of them, and the links between two
    of them."""
    ids = authors.select("author_id").distinct()
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(ids.select(F.col("author_id").alias(end)), end, "left_semi")
    return documents_of(papers, ids, doc, by), kept.select(*edges.columns)


def authors_by_degree(edges: DataFrame, least: int, most: int) -> DataFrame:
    """(author_id) with a number of co-authors within the limits."""
    return degrees(edges).where(F.col("degree").between(least, most)).select(F.col("id").alias("author_id"))


def authors_by_component(edges: DataFrame, sizes: tuple[int, int] | None = None, densities: tuple[float, float] | None = None) -> DataFrame:
    """(author_id) in connected components whose size and density lie within the limits, if given."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    labels = components(edges)
    kept = component_density(edges, labels)
    if sizes is not None:
        kept = kept.where(F.col("vertices").between(*sizes))
    if densities is not None:
        kept = kept.where(F.col("density").between(*densities))
    return labels.join(kept.select("component"), "component", "left_semi").select(F.col("id").alias("author_id"))


def authors_connected_with(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """(author_id) of everybody in the connected components of the given authors (column author_id)."""
    labels = components(edges)
    chosen = labels.join(authors.select(F.col("author_id").alias("id")), "id", "left_semi").select("component").distinct()
    return labels.join(chosen, "component", "left_semi").select(F.col("id").alias("author_id"))


def propagate_labels(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """(id, label): synchronous majority labels from fixed ones (id, label), until nothing changes. Unlabelled
    neighbours do not vote; ties go to the smaller label; vertices that no label reaches are left out. Where two
    patterns alternate for ever, the vertices that change get the smaller of their two labels."""
    pairs = checkpointed(both_ways(edges))
    fixed = checkpointed(fixed.select("id", "label"))
    labels, before = fixed, None
    for _ in range(MAX_ROUNDS):
        votes = pairs.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("m"))).alias("label"))
        fresh = best.select(F.col("a").alias("id"), "label").join(fixed.select("id"), "id", "left_anti")
        new = checkpointed(fresh.unionByName(fixed))
        if new.exceptAll(labels).limit(1).count() == 0:
            return new
        if before is not None and new.exceptAll(before).limit(1).count() == 0:
            last = labels.select("id", F.col("label").alias("last"))
            return new.join(last, "id").select("id", F.least("label", "last").alias("label"))
        labels, before = new, labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def hop_distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, id, hops) of everything that each source (column source) reaches, within ``most`` hops if given; the
    sources are a chosen set. Level by level until nothing new is met, each vertex once per source."""
    pairs = checkpointed(both_ways(edges))
    seen = front = checkpointed(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("hops")))
    hop = 0
    while most is None or hop < most:
        hop += 1
        reached = front.join(pairs, front["id"] == pairs["a"]).select("source", F.col("b").alias("id")).distinct()
        front = checkpointed(reached.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.limit(1).count() == 0:
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def distance_by_hops(hops: DataFrame, vectors: DataFrame, metric, seed: int = 0) -> DataFrame:
    """(source, hops, id, distance): of each source and hop count one vertex, chosen by a seeded hash, and the
    distance of the two vectors (id, v)."""
    pick = Window.partitionBy("source", "hops").orderBy(F.xxhash64("source", "id", F.lit(seed)), "id")
    known = hops.where("hops > 0").join(vectors.select("id", "v"), "id").join(vectors.select(F.col("id").alias("source"), F.col("v").alias("sv")), "source")
    one = known.withColumn("n", F.row_number().over(pick)).where("n = 1")
    return one.select("source", "hops", "id", metric("sv", "v").alias("distance"))


#: Sources that one task follows together over the arrays of a graph.
TOGETHER = 64


def distance_by_path_length(edges: DataFrame, sources: DataFrame, vectors: DataFrame, metric, seed: int = 0, array_links: int = ARRAY_LINKS) -> DataFrame:
    """What ``distance_by_hops`` gives of the ``hop_distances`` of all sources (column source). Up to ``array_links`` links
    each task has the graph as arrays and follows 64 sources at once, and only the chosen vertices become rows; beyond them
    every vertex is a row for each source."""
    links = checkpointed(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    vectors = vectors.select("id", "v")
    if links.count() > array_links:
        return distance_by_hops(hop_distances(edges, sources), vectors, metric, seed)
    spark = edges.sparkSession
    names, begin, near = link_arrays(links)
    has = np.isin(names, vectors.select("id").toArrow().column("id").to_numpy())
    chosen = sources.join(vectors.select(F.col("id").alias("source")), "source", "left_semi").distinct()
    chosen = np.intersect1d(chosen.toArrow().column("source").to_numpy(), names)
    graph = spark.sparkContext.broadcast((names, begin, near, has, np.searchsorted(names, chosen)))
    tasks = max(1, -(-len(chosen) // TOGETHER))

    def follow(batches):
        import pyarrow as pa

        names, begin, near, has, chosen = graph.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = one_of_each_hop(chosen[k::tasks], has, names, begin, near, seed)
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["source", "hops", "id"])

    one = checkpointed(spark.range(0, tasks, 1, tasks).mapInArrow(follow, "source bigint, hops int, id bigint"))
    graph.unpersist()
    known = one.join(vectors, "id").join(vectors.select(F.col("id").alias("source"), F.col("v").alias("sv")), "source")
    return known.select("source", "hops", "id", metric("sv", "v").alias("distance"))


def link_scores(predicted: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of predicted edges against the test edges. Training edges do not
    count as hits; a ratio with nothing below it is 0."""
    p, t, known = (x.select("src", "dst").distinct() for x in (predicted, test, train))
    new = p.join(known, ["src", "dst"], "left_anti")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = one(new.join(t, ["src", "dst"], "left_semi"), "tp").join(F.broadcast(one(p.join(t, ["src", "dst"], "left_anti"), "fp"))).join(F.broadcast(one(t.join(p, ["src", "dst"], "left_anti"), "fn")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    row = row.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return row.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` and ``nmi`` of two labelings, from their contingency table (arithmetic mean in the NMI)."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    n = cells.agg(F.sum("n").alias("t"))
    parts = [
        side.join(F.broadcast(n)).agg(F.sum(two(F.col("n"))).alias(f"pairs_{k}"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(f"h_{k}"))
        for k, side in (("a", rows), ("b", cols))
    ]
    x = cells.join(F.broadcast(n)).agg(F.sum(two(F.col("n"))).alias("both"), F.first("t").alias("t"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("h_ab"))
    row = x.join(F.broadcast(parts[0])).join(F.broadcast(parts[1]))
    expected = F.coalesce(F.try_divide(F.col("pairs_a") * F.col("pairs_b"), two(F.col("t"))), F.lit(0.0))
    top = (F.col("pairs_a") + F.col("pairs_b")) / 2
    ari = F.when(top - expected == 0, 1.0).otherwise((F.col("both") - expected) / (top - expected))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    nmi = F.when(mean > 0, (F.col("h_a") + F.col("h_b") - F.col("h_ab")) / mean).otherwise(1.0)
    return row.select(ari.alias("ari"), nmi.alias("nmi"))


#: Links that the driver may hold for the sequential part of ``louvain`` (about 50 bytes a link).
DRIVER_LINKS = 2_000_000
#: Rounds of moves on one level of the distributed part.
MOVES = 12


def louvain(edges: DataFrame, resolution: float = 1.0, driver_links: int = DRIVER_LINKS, array_links: int = ARRAY_LINKS) -> DataFrame:
    """(id, community): greedy modularity, one level after another.

    A graph of more than ``driver_links`` distinct links is first moved and contracted level by level until it fits: on the
    cluster (see ``_moved``) while it has more than ``array_links``, then in the same way over arrays on the driver. What
    fits is moved vertex by vertex, in order, on the driver. RuntimeError if moves no longer contract a graph that does not fit.
    """
    distinct = checkpointed(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    n = 2 * distinct.count()
    if 2 * driver_links < n <= 2 * array_links:
        names, begin, near = link_arrays(distinct)
        return _on_arrays(edges.sparkSession, names, begin, near, np.broadcast_to(1.0, len(near)), resolution, driver_links)
    links = checkpointed(both_ways(distinct).select("a", "b", F.lit(1.0).alias("w")))
    members = None  # (id, v): where a vertex stands on the current level
    while n > 2 * max(driver_links, array_links):
        to = _moved(links, resolution)
        members = to.select(F.col("v").alias("id"), F.col("c").alias("v")) if members is None else checkpointed(members.join(to, "v").select("id", F.col("c").alias("v")))
        one, two = to.select(F.col("v").alias("a"), F.col("c").alias("ca")), to.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        links = checkpointed(links.join(one, "a").join(two, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        left = links.count()
        if left > 2 * max(driver_links, array_links) and left > 0.95 * n:
            raise RuntimeError(f"{n} links do not contract any further")
        n = left
    if n > 2 * driver_links:
        table = links.orderBy("a", "b").toArrow()
        a, b = (table.column(c).to_numpy().astype(np.int64) for c in "ab")
        names = np.unique(a)
        begin = np.searchsorted(a, np.append(names, names[-1] + 1))
        last = _on_arrays(edges.sparkSession, names, begin, np.searchsorted(names, b).astype(np.int32), table.column("w").to_numpy().astype(float), resolution, driver_links)
        last = last.select(F.col("id").alias("v"), F.col("community").alias("c"))
    else:
        last = _greedy(links, resolution)
    return last.select(F.col("v").alias("id"), F.col("c").alias("community")) if members is None else members.join(last, "v").select("id", F.col("c").alias("community"))


def _on_arrays(spark: SparkSession, names: np.ndarray, begin: np.ndarray, near: np.ndarray, value: np.ndarray, resolution: float, driver_links: int) -> DataFrame:
    """(id, community): levels as in ``louvain`` over sorted arrays, until ``driver_links`` are left, then vertex by vertex."""
    ids, member = names, np.arange(len(names))
    while len(near) > 2 * driver_links:
        n = len(near)
        to = moved_on_arrays(names, begin, near, value, resolution, MOVES)
        kept, group = np.unique(to, return_inverse=True)
        codes, sums = contracted(begin, near, value, group, len(kept))
        del near, value
        member, names = group[member], names[kept]
        begin = np.searchsorted(codes, np.arange(len(names) + 1) * len(names))
        near, value = (codes % len(names)).astype(np.int32), sums
        del codes, sums
        if len(near) > 0.95 * n and len(near) > 2 * driver_links:
            raise RuntimeError(f"{n} links do not contract any further")
    codes = np.repeat(np.arange(len(names), dtype=np.int64), np.diff(begin)) * len(names) + near
    del near
    best = _in_order(codes, value, names, resolution)
    return spark.createDataFrame(pa.table({"id": ids, "community": best[member]}))


def _moved(links: DataFrame, resolution: float) -> DataFrame:
    """(v, c): communities after rounds of moves over weighted links (a, b, w), both ways, with loops. In each round a
    hashed half of the vertices moves to the neighbouring community of the highest gain, so that neighbours rarely swap."""
    weights = checkpointed(links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")))
    m2 = weights.agg(F.sum("k")).first()[0]
    own = checkpointed(weights.select("v", "k", F.col("v").alias("c")))
    for turn in range(MOVES):
        total = own.groupBy("c").agg(F.sum("k").alias("t"))
        near = links.where("a <> b").join(own.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
        stay = own.select("v", "c", F.lit(0.0).alias("w"))  # a vertex may always stay
        choices = near.unionByName(stay).groupBy("v", "c").agg(F.sum("w").alias("w"))
        here = own.select("v", "k", F.col("c").alias("home"))
        rest = F.col("t") - F.when(F.col("c") == F.col("home"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - F.lit(resolution) * rest * F.col("k") / F.lit(m2)
        scored = choices.join(here, "v").join(total, "c").withColumn("gain", gain)
        best = scored.groupBy("v", "k", "home").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("home")).alias("same"), (-F.col("c")).alias("o"))).alias("best"))
        mine = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0
        moved = checkpointed(best.select("v", "k", F.when(mine, F.col("best")).otherwise(F.col("home")).alias("c"), (mine & (F.col("best") != F.col("home"))).alias("went")))
        went = moved.where("went").count()
        own = moved.select("v", "k", "c")
        if turn > 0 and went == 0:
            break
    return own.select("v", "c")


def _greedy(links: DataFrame, resolution: float) -> DataFrame:
    """(v, c): moves in the order of vertices, level after level, on the driver; ``links`` as in ``_moved``."""
    spark = links.sparkSession
    rows = links.orderBy("a", "b").toArrow()
    ends = [rows.column(c).to_numpy().astype(np.int64) for c in "ab"]
    value = rows.column("w").to_numpy().astype(float)
    names, flat = np.unique(np.concatenate(ends), return_inverse=True)
    half = len(ends[0])
    best = _in_order(flat[:half] * len(names) + flat[half:], value, names, resolution)
    return spark.createDataFrame(list(zip(names.tolist(), best.tolist())), "v bigint, c bigint")


def _in_order(codes: np.ndarray, value: np.ndarray, names: np.ndarray, resolution: float) -> np.ndarray:
    """The community of each vertex; ``codes``: vertex times number of vertices plus neighbour, rising, both ways."""
    member = np.arange(len(names))
    while len(names):
        size = len(names)
        row, near = np.divmod(codes, size)
        begin = np.searchsorted(row, np.arange(size + 1)).tolist()
        m2 = float(value.sum()) or 1.0
        weight = np.bincount(row, value, size).tolist()
        own, total = list(range(size)), list(weight)
        moved_any = False
        for _ in range(50):
            moved = False
            for v in range(size):
                part = slice(begin[v], begin[v + 1])
                links: dict[int, float] = {}
                for u, w in zip(near[part].tolist(), value[part].tolist()):
                    if u != v:
                        links[own[u]] = links.get(own[u], 0.0) + w
                home = own[v]
                total[home] -= weight[v]
                gain = lambda c: links.get(c, 0.0) - resolution * total[c] * weight[v] / m2  # noqa: E731, B023
                best = max(sorted({home, *links}), key=lambda c: (gain(c), c == home))
                total[best] += weight[v]
                if best != home:
                    own[v] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            break
        kept, group = np.unique(np.array(own), return_inverse=True)
        member, names = group[member], names[kept]
        codes, at = np.unique(group[row] * len(kept) + group[near], return_inverse=True)
        value = np.bincount(at, value)
        if len(kept) == size:
            break
    return names[member]
