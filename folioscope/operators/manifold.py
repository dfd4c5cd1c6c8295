"""Neighbours, diffusion, hierarchical clustering and embeddings of topics.

Topics are few (hundreds to thousands) while their vocabularies and the documents are not. So distances come from
joins over sparse topics, and only what is bounded by a checked number of topics is worked on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpointed

#: Topics whose square matrix the driver may hold.
MAX_TOPICS = 4_000


#: Entries of one group of terms in ``hellinger_pairs``.
GROUP_ENTRIES = 2_000_000


def hellinger_pairs(topics: DataFrame) -> DataFrame:
    """(i, j, distance), i < j, of sparse topics (topic, term, p) that share a term: sqrt(1 - sum sqrt(p q)) with each
    topic divided by its sum. Pairs that share none have distance 1 and no row.

    Terms are spread over groups of about GROUP_ENTRIES entries. A group multiplies its part of the topics as one numpy
    matrix and gives one number per pair of topics, so a term that all topics hold makes no rows of its own.
    """
    norm = checkpointed(topics.where("p > 0").select("topic", "term", (F.col("p") / F.sum("p").over(Window.partitionBy("topic"))).alias("p")))
    groups = max(1, -(-norm.count() // GROUP_ENTRIES))
    kind = dict(norm.dtypes)["topic"]

    def gram(frame: pd.DataFrame) -> pd.DataFrame:
        rows, names = pd.factorize(frame["topic"], sort=True)
        columns = pd.factorize(frame["term"])[0]
        x = np.zeros((len(names), columns.max() + 1), dtype=np.float64)
        x[rows, columns] = np.sqrt(frame["p"].to_numpy())
        product = np.triu(x @ x.T, 1)
        i, j = np.nonzero(product)
        return pd.DataFrame({"i": np.asarray(names)[i], "j": np.asarray(names)[j], "bc": product[i, j]})

    spread = norm.withColumn("group", F.pmod(F.xxhash64("term"), F.lit(groups)))
    met = spread.groupBy("group").applyInPandas(gram, f"i {kind}, j {kind}, bc double").groupBy("i", "j").agg(F.sum("bc").alias("bc"))
    return met.select("i", "j", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("bc"))).alias("distance"))


def nearest_topics(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, distance, rank): the k nearest of each topic from pairs i < j; ties by the smaller topic."""
    both = pairs.select("i", "j", "distance").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def diffusion_weights(knn: DataFrame) -> DataFrame:
    """(i, j, w): 1 - d / sum of d over the topic's neighbours; topics whose distances sum to 0 give no row."""
    total = F.sum("distance").over(Window.partitionBy("i"))
    return knn.withColumn("t", total).where("t > 0").select("i", "j", (1 - F.col("distance") / F.col("t")).alias("w"))


def diffuse(weights: DataFrame, dist: DataFrame, key: str, rate: float = 0.7, rounds: int = 1) -> DataFrame:
    """(key, topic, p): mass flows along W to entries that were zero, scaled by ``rate``; known entries stay; each
    distribution is then divided by its sum. ``dist`` is sparse (key, topic, p)."""
    known = dist.where("p > 0")
    state = known
    for _ in range(rounds):
        moved = state.join(weights, F.col("topic") == F.col("j")).groupBy(key, F.col("i").alias("topic")).agg((F.sum(F.col("w") * F.col("p")) * rate).alias("p"))
        fresh = moved.where("p > 0").join(known.select(key, "topic"), [key, "topic"], "left_anti")
        state = known.select(key, "topic", "p").unionByName(fresh)
    return state.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))


def distance_matrix(topics: DataFrame, pairs: DataFrame, knn: int | None = None, mask: float = 1.0) -> tuple[list, np.ndarray]:
    """(topic ids, symmetric matrix) on the driver for at most MAX_TOPICS topics; pairs without a row, or outside the
    k nearest if ``knn`` is given, have distance ``mask``."""
    ids = [r[0] for r in topics.select("topic").distinct().orderBy("topic").limit(MAX_TOPICS + 1).collect()]
    if len(ids) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    place = {t: n for n, t in enumerate(ids)}
    d = np.full((len(ids), len(ids)), mask)
    np.fill_diagonal(d, 0.0)
    rows = (nearest_topics(pairs, min(knn, len(ids) - 1)) if knn else pairs).select("i", "j", "distance").collect()
    for i, j, x in rows:
        d[place[i], place[j]] = d[place[j], place[i]] = x
    return ids, d


def linkage(d: np.ndarray, method: str = "ward") -> np.ndarray:
    """Rows (left, right, height, size) of agglomerative clustering by Lance-Williams updates: ward, average, single or
    complete. New clusters are numbered from n; ties go to the smaller numbers."""
    n = len(d)
    if method not in ("ward", "average", "single", "complete"):
        raise ValueError(f"unknown method {method!r}")
    dist = d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    size = np.ones(n)
    name = list(range(n))
    alive = np.ones(n, bool)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(dist), dist.shape)
        i, j = min(i, j), max(i, j)
        h = dist[i, j]
        a, b = sorted((name[i], name[j]))
        out[step] = a, b, h, size[i] + size[j]
        others = alive.copy()
        others[[i, j]] = False
        x, y, s = dist[i, others], dist[j, others], size[others]
        if method == "ward":
            t = size[i] + size[j] + s
            new = np.sqrt(np.maximum(((size[i] + s) * x**2 + (size[j] + s) * y**2 - s * h**2) / t, 0))
        elif method == "average":
            new = (size[i] * x + size[j] * y) / (size[i] + size[j])
        else:
            new = np.minimum(x, y) if method == "single" else np.maximum(x, y)
        dist[i, others] = dist[others, i] = new
        dist[j, :] = dist[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + step
    return out


def cut(z: np.ndarray, height: float, relative: bool = False) -> list[int]:
    """Cluster number from 1 of each leaf after cutting at ``height`` (a share of the range of heights if
    ``relative``); numbers follow the order of first leaves."""
    n = len(z) + 1
    if relative:
        low, high = (z[:, 2].min(), z[:, 2].max()) if len(z) else (0.0, 0.0)
        height = rescaled(height, low, high)
    parent = list(range(2 * n - 1))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for step, (a, b, h, _) in enumerate(z):
        if h <= height:
            parent[root(int(a))] = parent[root(int(b))] = n + step
    seen: dict[int, int] = {}
    return [seen.setdefault(root(v), len(seen) + 1) for v in range(n)]


def rescaled(x: float, low: float, high: float) -> float:
    """low + x * (high - low) for x in [0, 1], else ValueError."""
    if not 0 <= x <= 1:
        raise ValueError("x must lie in [0, 1]")
    return low + x * (high - low)


def principal_axes(x: np.ndarray, n: int = 2) -> np.ndarray:
    """Coordinates on the first ``n`` principal axes; the largest loading of each axis is positive."""
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (u * s * sign)[:, :n]


def classical_scaling(d: np.ndarray, n: int = 2) -> np.ndarray:
    """Coordinates whose distances approximate ``d``."""
    size = len(d)
    centre = np.eye(size) - 1 / size
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    order = np.argsort(-values)[:n]
    coords = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return coords * np.sign(coords[np.abs(coords).argmax(axis=0), np.arange(coords.shape[1])] + 1e-300)


def potential_embedding(d: np.ndarray, n: int = 2, knn: int = 5, decay: float = 40.0, steps: int | None = None) -> np.ndarray:
    """Diffusion-potential embedding of a distance matrix: an adaptive kernel exp(-(d / sigma)^decay) with the distance
    to the knn-th neighbour as width, a random walk of ``steps`` steps (the knee of the von Neumann entropy if None),
    log potentials, and classical scaling of their distances."""
    size = len(d)
    width = np.sort(d, axis=1)[:, min(knn, size - 1)][:, None] + 1e-12
    kernel = (np.exp(-((d / width) ** decay)) + np.exp(-((d / width.T) ** decay))) / 2
    walk = kernel / kernel.sum(axis=1, keepdims=True)
    if steps is None:
        root = np.sqrt(kernel.sum(axis=1))
        values = np.abs(np.linalg.eigvalsh(kernel / root[:, None] / root[None, :]))
        curve = []
        power = values.copy()
        for _ in range(50):
            p = power / power.sum()
            curve.append(-(p[p > 0] * np.log(p[p > 0])).sum())
            power = power * values
        curve = np.array(curve)
        line = np.linspace(curve[0], curve[-1], len(curve))
        steps = int(np.argmax(line - curve)) + 1
    moved = np.linalg.matrix_power(walk, steps)
    potential = -np.log(moved + 1e-7)
    sq = (potential**2).sum(axis=1)
    return classical_scaling(np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * potential @ potential.T, 0)), n)


def _near_extreme(x: np.ndarray, how: str, slack: float) -> np.ndarray:
    """Which values lie within ``slack`` of the largest ("max") or smallest ("min"); all for another word."""
    if how == "max":
        return x >= x.max() - slack
    return x <= x.min() + slack if how == "min" else np.ones(len(x), bool)


def smooth_path(
    points: np.ndarray, axis: int = 0, second: int = 1, third: int | None = None, n: int = 10, second_method: str = "max",
    second_range: tuple[float, float] | None = None, third_method: str = "max", tolerance: float = 0.05, step_tolerance: float = 0.5,
) -> list[int]:
    """Indices of a walk along ``axis`` in ``n`` steps, refined by ``refined_path``.

    At each step the points within ``tolerance`` of the axis' range are taken; of them those near the overall largest or
    smallest value of the second axis (``tolerance`` of its range), or within its percentiles ``second_range``
    ("percentile"); of them the first one near the extreme of the third axis among them, at both ends the extreme itself.
    Steps without a point are left out. Without a third axis (two-dimensional points) the second one takes its part.
    """
    third = (2 if points.shape[1] > 2 else second) if third is None else third
    x, y, z = points[:, axis], points[:, second], points[:, third]
    grid = np.linspace(x.min(), x.max(), n)
    if second_method == "percentile" and second_range is not None:
        low, high = np.percentile(y, second_range)
        allowed = (y >= low) & (y <= high)
    else:
        allowed = _near_extreme(y, second_method, tolerance * (y.max() - y.min()))
    path: list[int] = []
    for step, g in enumerate(grid):
        chosen = np.flatnonzero((np.abs(x - g) <= tolerance * (x.max() - x.min())) & allowed)
        if len(chosen):
            slack = 0.0 if step in (0, n - 1) else tolerance * (z[chosen].max() - z[chosen].min())
            path.append(int(chosen[_near_extreme(z[chosen], third_method, slack)][0]))
    return refined_path(points, path, step_tolerance)


def refined_path(points: np.ndarray, path: list[int], tolerance: float = 0.5, rounds: int = 100) -> list[int]:
    """Interior points farther from the midpoint of their neighbours than ``tolerance`` times the neighbours' distance are
    replaced by the point nearest that midpoint if it lies within that radius, until nothing changes or ``rounds`` are
    over. Any point may be taken, a neighbour too, so an index can come twice."""
    path = list(path)
    for _ in range(rounds):
        before = list(path)
        for k in range(1, len(path) - 1):
            a, b = points[path[k - 1]], points[path[k + 1]]
            away = np.linalg.norm(points - (a + b) / 2, axis=1)
            radius = tolerance * np.linalg.norm(b - a)
            if away[path[k]] > radius and away.min() <= radius:
                path[k] = int(away.argmin())
        if path == before:
            break
    return path


def hellinger_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, distance): of every topic of ``left`` and every one of ``right`` (both topic, term, p) that share a term; the
    others have distance 1 and no row."""
    tagged = [
        df.where("p > 0").select(F.lit(side).alias("side"), "topic", "term", (F.col("p") / F.sum("p").over(Window.partitionBy("topic"))).alias("p"))
        for side, df in ((True, left), (False, right))
    ]
    both = checkpointed(tagged[0].unionByName(tagged[1]))
    groups = max(1, -(-both.count() // GROUP_ENTRIES))
    kind = dict(both.dtypes)["topic"]

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(at=pd.factorize(frame["term"])[0])
        sides = []
        for side in (True, False):
            part = frame[frame["side"] == side]
            rows, names = pd.factorize(part["topic"], sort=True)
            x = np.zeros((len(names), frame["at"].max() + 1))
            x[rows, part["at"].to_numpy()] = np.sqrt(part["p"].to_numpy())
            sides.append((x, np.asarray(names)))
        dot = sides[0][0] @ sides[1][0].T
        i, j = np.nonzero(dot)
        return pd.DataFrame({"i": sides[0][1][i], "j": sides[1][1][j], "bc": dot[i, j]})

    spread = both.withColumn("group", F.pmod(F.xxhash64("term"), F.lit(groups)))
    met = spread.groupBy("group").applyInPandas(product, f"i {kind}, j {kind}, bc double").groupBy("i", "j").agg(F.sum("bc").alias("bc"))
    return met.select("i", "j", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("bc"))).alias("distance"))


def placed_points(distances: np.ndarray, coords: np.ndarray, knn: int = 5, decay: float = 40.0) -> np.ndarray:
    """Coordinates of new points in a fitted embedding: the mean of their nearest fitted points, weighted by the kernel of
    ``potential_embedding``. ``distances``: new by fitted; a new point at distance 0 gets the fitted one's place.
    ValueError without fitted points."""
    if not len(coords):
        raise ValueError("nothing is fitted")
    width = np.sort(distances, axis=1)[:, [min(knn, len(coords)) - 1]] + 1e-12
    weights = np.exp(-((distances / width) ** decay)) / (distances / width + 1e-9)
    return weights @ coords / weights.sum(axis=1, keepdims=True)
