"""Topic trees as closure tables: node - leaf rows instead of pointers, so that sums, link probabilities, cuts and
common ancestors are joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tree_tables(spark: SparkSession, z: np.ndarray, leaf_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(nodes, closure) of a linkage over ``leaf_ids``. nodes: node, left, right, height, leaves (their number), depth;
    closure: node, leaf. Leaves keep the positions 0..n-1 as node numbers. The tree is bounded by the number of
    topics that was clustered on the driver."""
    n = len(leaf_ids)
    under: list[list[int]] = [[i] for i in range(n)]
    rows = [(i, None, None, 0.0, 1) for i in range(n)]
    depth = [1] * n
    for step, (a, b, h, _) in enumerate(z):
        under.append(under[int(a)] + under[int(b)])
        depth.append(max(depth[int(a)], depth[int(b)]) + 1)
        rows.append((n + step, int(a), int(b), float(h), len(under[-1])))
    nodes = spark.createDataFrame([(*r, d) for r, d in zip(rows, depth)], "node int, left int, right int, height double, leaves int, depth int")
    closure = spark.createDataFrame([(v, leaf_ids[i]) for v, own in enumerate(under) for i in own] or [], "node int, leaf int")
    return nodes, closure


def preorder(z: np.ndarray, n: int) -> list[int]:
    """Node numbers: root, then the left subtree, then the right one."""
    stack, out = [2 * n - 2] if n else [], []
    while stack:
        v = stack.pop()
        out.append(v)
        if v >= n:
            stack += [int(z[v - n, 1]), int(z[v - n, 0])]
    return out


def postorder(z: np.ndarray, n: int) -> list[int]:
    """Node numbers: left subtree, right subtree, then the node."""
    stack, out = [2 * n - 2] if n else [], []
    while stack:
        v = stack.pop()
        out.append(v)
        if v >= n:
            stack += [int(z[v - n, 0]), int(z[v - n, 1])]
    return out[::-1]


def node_authors(closure: DataFrame, dist: DataFrame) -> DataFrame:
    """(node, author_id, p): an author's mass below each node; ``dist`` is sparse (author_id, topic, p)."""
    met = closure.join(dist, closure["leaf"] == dist["topic"])
    return met.groupBy("node", "author_id").agg(F.sum("p").alias("p"))


def height_range(nodes: DataFrame) -> DataFrame:
    """One row: lowest and highest height of the inner nodes (nulls without any)."""
    return nodes.where("left IS NOT NULL").agg(F.min("height").alias("lowest"), F.max("height").alias("highest"))


def link_probabilities(splits: DataFrame, mass: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, probability) for the inner nodes ``splits`` (node, left, right): over all edges u-v,
    sum of L_u (1 - R_u) R_v (1 - L_v) both ways, divided by sum L (1 - R) * sum R (1 - L); 0 if that is 0.
    ``mass``: (node, author_id, p), see ``node_authors``; authors without a row have 0."""
    inner = splits.where("left IS NOT NULL").select("node", "left", "right")
    sides = [
        inner.join(mass.withColumnRenamed("node", side), side).select("node", "author_id", F.col("p").alias(name))
        for side, name in (("left", "l"), ("right", "r"))
    ]
    both = sides[0].join(sides[1], ["node", "author_id"], "full").fillna(0.0, ["l", "r"])
    only = both.select("node", "author_id", (F.col("l") * (1 - F.col("r"))).alias("x"), (F.col("r") * (1 - F.col("l"))).alias("y"))
    below = only.groupBy("node").agg((F.sum("x") * F.sum("y")).alias("pairs"))
    u = only.select("node", F.col("author_id").alias("src"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    v = only.select("node", F.col("author_id").alias("dst"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    linked = edges.select("src", "dst").join(u, "src").join(v, ["node", "dst"])
    hits = linked.groupBy("node").agg(F.sum(F.col("xu") * F.col("yv") + F.col("xv") * F.col("yu")).alias("linked"))
    joined = inner.select("node").join(below, "node", "left").join(hits, "node", "left")
    return joined.select("node", F.when(F.col("pairs") > 0, F.coalesce("linked", F.lit(0.0)) / F.col("pairs")).otherwise(0.0).alias("probability"))


def truncate(nodes: DataFrame, height: float) -> DataFrame:
    """Nodes that are leaves after cutting at ``height``: those below it whose parent is not (the root if all are)."""
    parents = nodes.where("left IS NOT NULL").select(F.explode(F.array("left", "right")).alias("node"), F.col("height").alias("up"))
    return nodes.join(parents, "node", "left").where((F.col("height") < height) & (F.col("up").isNull() | (F.col("up") >= height))).select("node", "height", "leaves")


def common_ancestors(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, node), a < b: the smallest node above both leaves. Bounded by the square of the number of topics."""
    size = closure.join(nodes.select("node", "leaves"), "node")
    met = size.select("node", F.col("leaf").alias("a"), "leaves").join(closure.select("node", F.col("leaf").alias("b")), "node").where("a < b")
    return met.groupBy("a", "b").agg(F.min_by("node", F.struct("leaves", "node")).alias("node"))


def link_likelihood(edges: DataFrame, dist: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, score): sum over topics i, j of P_u(i) P_v(j) L(i, j), lowest first when sorted by score. ``links`` is the
    long symmetric table (i, j, p); pairs without a row count as 0."""
    u = edges.select("src", "dst").join(dist.select(F.col("author_id").alias("src"), F.col("topic").alias("i"), F.col("p").alias("pu")), "src")
    # P_u L first, one row per edge and j
    reach = u.join(links, "i").groupBy("src", "dst", "j").agg(F.sum(F.col("pu") * F.col("p")).alias("x"))
    v = dist.select(F.col("author_id").alias("dst"), F.col("topic").alias("j"), F.col("p").alias("pv"))
    return reach.join(v, ["dst", "j"]).groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("pv")).alias("score"))


def leaf_groups(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """(author_id, leaf, p): an author's mass per group of topics (topic, leaf), divided by its sum."""
    s = dist.join(groups, "topic").groupBy("author_id", "leaf").agg(F.sum("p").alias("p"))
    return s.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("author_id")))


def cut_groups(closure: DataFrame, cells: DataFrame) -> DataFrame:
    """(topic, leaf): the cell (see ``truncate``) that each topic lies in."""
    return closure.join(cells.select("node"), "node").select(F.col("leaf").alias("topic"), F.col("node").alias("leaf"))


def link_table(closure: DataFrame, nodes: DataFrame, cells: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(i, j, p), both ways and with the diagonal: link probability of two cells (the leaves of a cut tree, column node),
    which is that of the smallest node above both, or of the cell itself on the diagonal. ``probabilities``: see
    ``link_probabilities``; nodes without a row, such as single topics, have 0. Bounded by the square of the cells."""
    # any node above one topic of each of two cells is above both cells
    topic = closure.join(cells.select("node"), "node").groupBy(F.col("node").alias("cell")).agg(F.min("leaf").alias("leaf"))
    above = topic.join(closure, "leaf").join(nodes.select("node", "leaves"), "node").select("cell", "node", "leaves")
    one, two = above.select(F.col("cell").alias("i"), "node", "leaves"), above.select(F.col("cell").alias("j"), "node")
    common = one.join(two, "node").where("i <> j").groupBy("i", "j").agg(F.min_by("node", F.struct("leaves", "node")).alias("node"))
    own = cells.select(F.col("node").alias("i"), F.col("node").alias("j"), "node")
    known = probabilities.select("node", F.col("probability").alias("p"))
    return common.unionByName(own).join(known, "node", "left").select("i", "j", F.coalesce("p", F.lit(0.0)).alias("p"))
