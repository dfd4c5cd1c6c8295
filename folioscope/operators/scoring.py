"""Interdisciplinarity scores, rankings and link prediction over sparse distributions (key, topic, p)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.numbering import numbered
from folioscope.session import checkpointed


def _entropy(p: Column) -> Column:
    return F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def author_scores(dist: DataFrame, publications: DataFrame, keep: int | None = None, by_entropy: bool = True, weighted: bool = True) -> DataFrame:
    """(author_id, score): entropy in bits (or 1 - largest share) of the ``keep`` largest topics, renormalised, times
    ln(1 + publications). ``publications``: author_id, n; authors without a row there have 0."""
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("p"), "topic"))
    top = dist.withColumn("r", rank).where(F.col("r") <= keep) if keep else dist
    total = F.sum("p").over(Window.partitionBy("author_id"))
    share = top.withColumn("q", F.col("p") / total)
    score = share.groupBy("author_id").agg((_entropy(F.col("q")) if by_entropy else 1 - F.max("q")).alias("score"))
    if not weighted:
        return score
    with_n = score.join(publications.select("author_id", "n"), "author_id", "left")
    return with_n.select("author_id", (F.col("score") * F.log1p(F.coalesce("n", F.lit(0)))).alias("score"))


def document_scores(theta: DataFrame, doc: str, topics: int, weights: DataFrame | None = None, eps: float = 1e-10) -> DataFrame:
    """(doc, score): entropy in bits of (p + eps) renormalised over all ``topics``; entries without a row enter in closed
    form, nothing is made dense. ``weights`` (doc, w), e.g. the mean square root of the authors' publications."""
    whole = F.sum("p") + topics * eps
    # sum over present entries of x ln x with x = (p + eps) / whole, from two sums
    y = F.col("p") + eps
    present = F.sum(y * F.log2(y))
    sums = theta.groupBy(doc).agg(whole.alias("t"), present.alias("s"), F.sum(y).alias("m"), F.count(F.lit(1)).alias("k"))
    rest = (topics - F.col("k")) * eps * F.log2(F.lit(eps))
    score = -(F.col("s") + rest) / F.col("t") + F.log2("t")
    out = sums.select(doc, score.alias("score"))
    if weights is None:
        return out
    return out.join(weights, doc, "left").select(doc, (F.col("score") * F.coalesce("w", F.lit(1.0))).alias("score"))


def team_scores(doc_author: DataFrame, dist: DataFrame, doc: str = "paper_id", eps: float = 1e-10) -> DataFrame:
    """(doc, score): entropy in bits of the mean of the distributions of a document's authors that have one."""
    have = doc_author.join(dist.select("author_id").distinct(), "author_id", "left_semi").select(doc, "author_id")
    n = have.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    mean = have.join(dist, "author_id").groupBy(doc, "topic").agg(F.sum("p").alias("s")).join(n, doc)
    q = F.col("s") / F.col("n")
    return mean.groupBy(doc).agg(F.sum(-q * F.log2(q + eps)).alias("score"))


def major_topic_scores(doc_author: DataFrame, dist: DataFrame, n: int = 1, doc: str = "paper_id") -> DataFrame:
    """(doc, score): the ``n`` largest topics of each author summed over the document's authors, normalised, entropy in
    bits. Documents with one author are left out."""
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("p"), "topic"))
    top = dist.withColumn("r", rank).where(F.col("r") <= n).select("author_id", "topic", "p")
    sums = doc_author.where("n_authors > 1").join(top, "author_id").groupBy(doc, "topic").agg(F.sum("p").alias("s"))
    q = sums.withColumn("q", F.col("s") / F.sum("s").over(Window.partitionBy(doc)))
    return q.groupBy(doc).agg(_entropy(F.col("q")).alias("score"))


def ranked(scores: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Highest score first, ties by key; the first ``n`` if given."""
    out = scores.orderBy(F.desc("score"), key)
    return out.limit(n) if n is not None else out


def top_percent(scores: DataFrame, key: str, percent: float = 5.0) -> DataFrame:
    """The first max(1, floor(n * percent / 100)) rows by score, ties by key. Rows are numbered over ranges of scores, so
    no task sorts or gathers more than one range, however many rows a percent is."""
    n = scores.count()
    if not n:
        return scores
    return numbered(scores, [F.desc("score"), key], "__rank").where(F.col("__rank") < max(1, int(n * percent / 100))).select(*scores.columns)


#: Bounds of score ranges; the driver holds the square of twice as many numbers.
TAU_RANGES = 128


def _weighted_order(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum over pairs of sign(dx) sign(dy) n n', by bits of the rank of y: in O(m log m), nothing is paired."""
    order = np.lexsort((y, x))
    x, n = x[order], n[order]
    rank = np.unique(y[order], return_inverse=True)[1]
    # rows of equal x stand together and must not count against each other: their pairs are taken off again
    return _below_minus_above(rank, n) - _below_minus_above(rank, n, np.unique(x, return_inverse=True)[1])


def _below_minus_above(rank: np.ndarray, n: np.ndarray, group: np.ndarray | None = None) -> float:
    """Over pairs i < j (within a group): n_i n_j for rank_i < rank_j, minus the same for rank_i > rank_j."""
    total = 0.0
    group = np.zeros(len(rank), np.int64) if group is None else group
    for bit in range(int(rank.max(initial=0)).bit_length()):
        # pairs that differ first in this bit share all higher ones
        _, part = np.unique(np.stack([group, rank >> (bit + 1)]), axis=1, return_inverse=True)
        part = part.reshape(-1)
        order = np.argsort(part, kind="stable")
        one = ((rank[order] >> bit) & 1).astype(bool)
        w, p = n[order], part[order]
        first = np.r_[True, p[1:] != p[:-1]]
        before = []
        for mask in (~one, one):
            c = np.cumsum(np.where(mask, w, 0.0)) - np.where(mask, w, 0.0)
            before.append(c - np.maximum.accumulate(np.where(first, c, 0.0)))
        total += float((w * np.where(one, before[0], -before[1])).sum())
    return total


def kendall_tau(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row ``tau``: tau-b of the scores of common keys, null where one of them has no order.

    Exact for any number of keys. Keys with the same two scores are one cell with its count. Both scores are cut into
    ranges (TAU_RANGES quantiles, a frequent score being a range of its own). Pairs of cells in different ranges of both
    scores come from a table of ranges by ranges; those in one range of x, and those in one range of y but not of x, are
    counted within that range, by sorting.
    """
    common = a.select(key, F.col("score").cast("double").alias("x")).join(b.select(key, F.col("score").cast("double").alias("y")), key)
    cells = checkpointed(common.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    shares = [i / TAU_RANGES for i in range(1, TAU_RANGES)]
    for c in "xy":
        bounds = sorted(set(cells.approxQuantile(c, shares, 1 / (4 * TAU_RANGES)))) if cells.take(1) else []
        known = F.array(*[F.lit(float(v)) for v in bounds]).cast("array<double>")
        below = F.size(F.filter(known, lambda v: v < F.col(c)))  # noqa: B023
        cells = cells.withColumn(f"r{c}", 2 * below + F.array_contains(known, F.col(c)).cast("int"))
    size = 2 * TAU_RANGES + 2
    table = np.zeros((size, size))
    for rx, ry, n in cells.groupBy("rx", "ry").agg(F.sum("n")).collect():  # at most size * size rows
        table[rx, ry] = n
    # all ranges below and to the left, minus all above and to the left
    left = np.vstack([np.zeros(size), np.cumsum(table, axis=0)[:-1]])
    lower = np.hstack([np.zeros((size, 1)), np.cumsum(left, axis=1)[:, :-1]])
    upper = left.sum(axis=1, keepdims=True) - lower - left
    apart = float((table * (lower - upper)).sum())

    def inside(one: str, two: str):
        def count(frame: pd.DataFrame) -> pd.DataFrame:
            x, y = frame[one].to_numpy(), frame[two].to_numpy()
            return pd.DataFrame({"s": [_weighted_order(x, y, frame["n"].to_numpy())]})

        return count

    # a range with a single score holds no ordered pair
    by_x = cells.where(F.col("rx") % 2 == 0).select("rx", "x", "y", "n").groupBy("rx").applyInPandas(inside("x", "y"), "s double")
    by_y = cells.where(F.col("ry") % 2 == 0).select("ry", "rx", "y", "n").groupBy("ry", "rx", "y").agg(F.sum("n").alias("n")).groupBy("ry").applyInPandas(inside("rx", "y"), "s double")
    within = by_x.unionByName(by_y).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    every = cells.agg(F.sum("n").alias("t"))
    ties = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias(f"t{c}")) for c in "xy"]
    row = within.join(F.broadcast(every)).join(F.broadcast(ties[0])).join(F.broadcast(ties[1]))  # one row each
    pairs = [(F.col("t") * F.col("t") - F.col(f"t{c}")) / 2 for c in "xy"]
    return row.select(F.try_divide(F.col("s") + apart, F.sqrt(pairs[0] * pairs[1])).alias("tau"))


def unseen_links(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): a stated set of candidate pairs without those that are linked already, each once. Scored with
    ``dendrogram.link_likelihood`` this is link prediction; all non-edges of a graph are never formed."""
    pairs = candidates.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.where("src < dst").join(known.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
