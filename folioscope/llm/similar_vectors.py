"""Most similar vectors for every vector: collision-counting hashing over single projections.

Distributions are divided by their sums and square-rooted, so that Hellinger distance is the Euclidean distance of
unit vectors over sqrt(2). Equal vectors are one class and are worked once.

Routing. A tree of projections, fitted on a bounded sample, sorts all vectors into leaves: each inner node projects on
the line through two sample vectors and cuts where few vectors lie near the cut. Every vector is stored in one leaf
only. It first asks in its own leaf, and then goes, as a query only, to the leaves whose cuts lie within a margin of
its own projections. The margin shrinks with the distance of its k-th neighbour so far, so a vector in a crowded place
travels little. A pair is found if either of its vectors reaches the other's leaf.

Within a leaf each of ``projections`` random lines gives one sorted array. A query's window around its own
projection widens by virtual rehashing, and a member that lies in the windows of enough arrays - the collision
threshold - is verified by its true distance. A query stops when it has its k neighbours within the distance its
windows cover, or when they cover the radius.

Cost. Leaves hold LEAF_VECTORS vectors as long as the sample can tell that many leaves apart (about SAMPLE / LEAF_SAMPLE
leaves); a vector is shuffled twice as a member and once for each leaf it travels to. How many those are depends on the
data: see README for measured numbers on peaked and dense vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpointed

PROJECTIONS = 20
#: Half-width of the widest window in radii, and the share of arrays that must collide: a member exactly at the
#: radius lies in one window with probability 0.89, so it misses the threshold with probability 0.0003.
WIDTH, THRESHOLD = 1.6, 0.6
#: Parts of the radius that the windows cover, one round after the other.
ROUNDS = (0.25, 1.0)
#: Query-member places counted at once.
STEP = 2_000_000
#: Vectors of a leaf, vectors the tree is fitted on (up to twice as many, by hash), and fewest of them in a leaf.
LEAF_VECTORS, SAMPLE, LEAF_SAMPLE = 1_000, 20_000, 12
#: Margin of a query at a cut in radii. Two vectors at the radius that are parted by a cut lie together at most one
#: radius from it, so 0.5 loses nothing; vectors of 64 dimensions differ along one line by an eighth of their
#: distance (standard deviation), and 0.15 finds more than 0.999 of them.
MARGIN = 0.15
#: Lines tried at each node.
CANDIDATES = 12
#: Links that are broadcast with a vector each to get their exact distances; beyond it the tables are shuffled.
BROADCAST_LINKS = 50_000
#: Queries of one group of work in a leaf that many vectors travel to.
BLOCK_QUERIES = 20_000


@dataclass
class Tree:
    """Inner nodes: line, cut, children (an inner node, or -1 - leaf); ``root`` likewise."""

    root: int
    lines: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int


def fit_tree(sample: np.ndarray, leaf: int, margin: float, seed: int) -> Tree:
    """A tree whose leaves hold at most ``leaf`` of the sample, unless they cannot be told apart."""
    rng = np.random.default_rng(seed)
    lines: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    leaves = 0
    todo = [(np.arange(len(sample)), -1, 0)]  # rows, parent, side
    root = -1
    while todo:
        rows, parent, side = todo.pop()
        best = _cut(sample[rows], margin, rng) if len(rows) > leaf else None
        if best is None:
            here = -1 - leaves
            leaves += 1
        else:
            line, cut, left = best
            here = len(lines)
            lines.append(line)
            cuts.append(cut)
            children.append([0, 0])
            todo += [(rows[left], here, 0), (rows[~left], here, 1)]
        if parent < 0:
            root = here
        else:
            children[parent][side] = here
    dims = sample.shape[1]
    return Tree(root, np.array(lines, np.float32).reshape(-1, dims), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2), leaves)


def _cut(x: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Line, cut and the rows left of it: of some lines through two rows, the middle cut with the fewest rows near it."""
    best = None
    for _ in range(CANDIDATES):
        i, j = rng.integers(len(x), size=2)
        line = x[i] - x[j]
        length = np.linalg.norm(line)
        if length < 1e-9:
            continue
        placed = x @ (line / length)
        cuts = np.quantile(placed, np.linspace(0.3, 0.7, 17))
        ranked = np.sort(placed)
        near = np.searchsorted(ranked, cuts + margin, "right") - np.searchsorted(ranked, cuts - margin)
        k = int(near.argmin())
        left = placed <= cuts[k]
        if left.any() and not left.all() and (best is None or near[k] < best[0]):
            best = (near[k], line / length, float(cuts[k]), left)
    return None if best is None else best[1:]


def route(tree: Tree, v: np.ndarray, margins: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaf of each vector, and the others it comes within its margin of."""
    row, node = np.arange(len(v)), np.full(len(v), tree.root)
    out = []
    while len(row):
        done = node < 0
        out.append((row[done], -1 - node[done]))
        row, node = row[~done], node[~done]
        away = np.einsum("ij,ij->i", v[row], tree.lines[node]) - tree.cuts[node]
        margin = np.broadcast_to(margins, len(v))[row]
        left, right = away <= margin, (away > 0) | (away > -margin)
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([tree.children[node[left], 0], tree.children[node[right], 1]])
    return np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])


def _verified(queries: np.ndarray, members: np.ndarray, collide: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, Euclidean distance) of the unit vectors that collide. Where these are many, distances come from one
    product, and of each query only the ``k`` nearest, with ties, are given."""
    if np.count_nonzero(collide) * 20 < collide.size:
        q, x = np.nonzero(collide)
        return q, x, np.sqrt(((queries[q] - members[x]).astype(np.float64) ** 2).sum(axis=1))
    a, b = queries.astype(np.float64), members.astype(np.float64)
    distance = np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))
    distance[~collide] = np.inf
    if distance.shape[1] > k:
        distance[distance > np.partition(distance, k - 1, axis=1)[:, k - 1 : k]] = np.inf
    q, x = np.nonzero(np.isfinite(distance))
    return q, x, distance[q, x]


def collision_search(
    queries: np.ndarray, members: np.ndarray, radius: float, k: int, seed: int = 7, projections: int = PROJECTIONS
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, Euclidean distance) of verified members within ``radius``; a query that found k within what
    its windows cover asks no further, so at least its k nearest within the radius are among its rows."""
    m, n = projections, len(members)
    lines = np.random.default_rng(seed).standard_normal((members.shape[1], m)).astype(np.float32)
    placed = members @ lines
    order = np.argsort(placed, axis=0, kind="stable")
    arrays = [placed[order[:, j], j] for j in range(m)]
    # the place of each member in each array, so a window [low, high) is one comparison of unsigned numbers
    kind = np.uint16 if n < 60_000 else np.uint32
    place = np.empty((m, n), dtype=kind)
    for j in range(m):
        place[j, order[:, j]] = np.arange(n, dtype=kind)
    need = int(np.ceil(THRESHOLD * m))
    chunk = max(1, STEP // max(1, n))
    for at in range(0, len(queries), chunk):
        own = queries[at : at + chunk]
        centre = own @ lines
        active = np.arange(len(own))
        for part in ROUNDS:
            cover = radius * part
            counts = np.zeros((len(active), n), dtype=np.uint8)
            for j in range(m):
                low = np.searchsorted(arrays[j], centre[active, j] - WIDTH * cover, "left").astype(kind)
                high = np.searchsorted(arrays[j], centre[active, j] + WIDTH * cover, "right").astype(kind)
                counts += (place[j][None, :] - low[:, None]) < (high - low)[:, None]
            q, x, distance = _verified(own[active], members, counts >= need, k)
            near = distance <= cover
            enough = np.bincount(q[near], minlength=len(active)) >= k
            # what is found is given once: in the last round, or when the query stops
            given = (distance <= radius) & (enough[q] | (part == ROUNDS[-1]))
            if given.any():
                yield active[q[given]] + at, x[given], distance[given]
            active = active[~enough]
            if not len(active):
                break


def usable_distributions(df: DataFrame, key: str, ts: str, vector: str) -> DataFrame:
    """(key, v): the current vector of each key divided by its sum, as ARRAY<DOUBLE>. Keys whose current vector is
    null, empty, holds a null, negative or non-finite number, or sums to 0 are left out."""
    row = F.struct(F.col(ts).alias("ts"), F.col(vector).alias("v"))
    current = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(row).alias("r"))
    current = current.select("key", F.col("r.v").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    current = current.where((F.size("v") > 0) & good).withColumn("s", total).where("s > 0")
    return current.select("key", F.transform("v", lambda x: x / F.col("s")).alias("v"))


def _found(queries: np.ndarray, members: np.ndarray, radius: float, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, Hellinger distance) within the radius."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(queries) and len(members):
        out += list(collision_search(queries, members, radius, k, seed))
    query, member, distance = (np.concatenate(c) for c in zip(*out))
    return query, member, distance / np.sqrt(2)


def _nearest(query: np.ndarray, member: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each query's ``k`` nearest members, with ties at the last distance: in a crowd of vectors that all lie
    within the radius nobody needs more."""
    order = np.lexsort((distance, query))
    query, member, distance = query[order], member[order], distance[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    last = _kth(query, distance, int(query[-1]) + 1 if len(query) else 0, k)
    keep = (rank < k) | (distance == last[query] if len(query) else False)
    return query[keep], member[keep], distance[keep]


def _kth(query: np.ndarray, distance: np.ndarray, n: int, k: int) -> np.ndarray:
    """Distance of the k-th nearest of each of ``n`` queries, infinite where there are fewer."""
    order = np.lexsort((distance, query))
    query, distance = query[order], distance[order]
    first = np.searchsorted(query, np.arange(n))
    out = np.full(n, np.inf)
    has = np.bincount(query, minlength=n) >= k
    out[has] = distance[first[has] + k - 1]
    return out


def similar_distributions(vectors: DataFrame, k: int, max_distance: float, seed: int = 7) -> DataFrame:
    """(key, other, distance, rank): for each key its ``k`` nearest other keys at a Hellinger distance of at most
    ``max_distance``, nearest first, ties by the smaller key.

    ``vectors`` has key (BIGINT, distinct) and v (ARRAY<DOUBLE>, non-negative, sum 1, see ``usable_distributions``),
    all of one length; shorter ones count as padded with zeros. Keys without such a neighbour give no row, nor does
    an empty table. All keys with the same vector are one class: the search runs over classes, and of each class
    only the k + 1 smallest keys can be anybody's neighbours.
    """
    radius = float(max_distance * np.sqrt(2)) + 1e-6
    rows = checkpointed(vectors.withColumn("class", F.xxhash64("v")))
    order = Window.partitionBy("class").orderBy("key")
    targets = rows.select("class", "key").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = checkpointed(rows.groupBy("class").agg(F.min("v").alias("v")))
    total, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = dims or 1

    def unit(lists: pd.Series) -> np.ndarray:
        v = np.zeros((len(lists), dims), dtype=np.float32)
        for i, x in enumerate(lists):
            v[i, : len(x)] = np.sqrt(x)
        return v

    drawn = classes.where(F.pmod("class", F.lit(max(1, total // SAMPLE))) == 0).select("class", F.transform("v", lambda x: x.cast("float")).alias("v"))
    # about SAMPLE vectors, whatever their number; in order, so that the tree does not depend on how the rows are spread
    sample = unit(drawn.toPandas().sort_values("class")["v"])
    leaf = max(LEAF_SAMPLE, LEAF_VECTORS * len(sample) // max(1, total))
    tree = fit_tree(sample, leaf, MARGIN * radius, seed)

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v = unit(frame["v"])
            row, where = route(tree, v)
            yield pd.DataFrame({"leaf": where.astype(np.int32), "class": frame["class"].to_numpy()[row], "bits": [v[i].tobytes() for i in row]})

    members = classes.mapInPandas(home, "leaf int, class bigint, bits binary")

    def vectors_of(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["bits"]), dtype=np.float32).reshape(len(frame), dims)

    def own_leaf(frame: pd.DataFrame) -> pd.DataFrame:
        v, ids = vectors_of(frame), frame["class"].to_numpy()
        query, member, distance = _found(v, v, radius, k + 1, seed)  # one more: each finds itself
        other = query != member
        query, member, distance = _nearest(query[other], member[other], distance[other], k)
        # a crowded vector needs only what is nearer than the k-th it has
        margins = MARGIN * np.minimum(radius, 2 * np.sqrt(2) * _kth(query, distance, len(v), k))
        row, where = route(tree, v, margins)
        away = where != frame["leaf"].iloc[0]
        row, where = row[away], where[away]
        low, high = np.minimum(query, member), np.maximum(query, member)
        _, once = np.unique(low * len(v) + high, return_index=True)
        near = pd.DataFrame({"class": ids[low[once]], "near": ids[high[once]], "distance": distance[once]}, columns=["class", "near", "distance", "leaf", "bits"])
        travels = pd.DataFrame({"class": ids[row], "leaf": where, "bits": [v[i].tobytes() for i in row]}, columns=near.columns)
        return pd.concat([x.astype({"near": "Int64", "leaf": "Int32"}) for x in (near, travels)], ignore_index=True)

    first = checkpointed(members.groupBy("leaf").applyInPandas(own_leaf, "class bigint, near bigint, distance double, leaf int, bits binary"))
    links, travels = first.where("near IS NOT NULL").select("class", "near", "distance"), first.where("leaf IS NOT NULL")
    # a leaf that many vectors travel to is worked in several groups, each with the leaf's members; one row per leaf
    crowd = travels.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("groups"))
    crowd = F.broadcast(crowd) if tree.leaves <= SAMPLE else crowd
    asks = travels.join(crowd, "leaf").select("leaf", F.pmod(F.xxhash64("class"), F.col("groups")).cast("int").alias("group"), "class", "bits", F.lit(True).alias("asks"))
    held = members.join(crowd, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "class", "bits", F.lit(False).alias("asks"))

    def other_leaf(frame: pd.DataFrame) -> pd.DataFrame:
        ask = frame["asks"].to_numpy()
        v, ids = vectors_of(frame), frame["class"].to_numpy()
        query, member, distance = _nearest(*_found(v[ask], v[~ask], radius, k, seed), k)
        return pd.DataFrame({"class": ids[ask][query], "near": ids[~ask][member], "distance": distance})

    second = asks.unionByName(held).groupBy("leaf", "group").applyInPandas(other_leaf, "class bigint, near bigint, distance double")
    links = checkpointed(links.unionByName(second))  # read in both directions below
    # both ways: what a finds b must also know
    both = links.unionByName(links.select(F.col("near").alias("class"), F.col("class").alias("near"), "distance"))
    both = both.groupBy("class", "near").agg(F.min("distance").alias("distance"))
    nearest = Window.partitionBy("class").orderBy("distance")
    # k + 1 classes are enough only by distance, so ties at the last distance are kept
    kept = both.withColumn("r", F.rank().over(nearest)).where(F.col("r") <= k + 1).select("class", "near")
    small = F.broadcast if links.count() <= BROADCAST_LINKS else lambda df: df
    one = classes.select("class", F.col("v").alias("p")).join(small(kept), "class")
    two = classes.select(F.col("class").alias("near"), F.col("v").alias("q")).join(small(one), "near")
    bc = F.aggregate(F.zip_with("p", "q", lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    kept = two.select("class", "near", F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - bc)).alias("distance")).where(F.col("distance") <= max_distance)
    # each class is its own neighbour at distance 0
    kept = kept.unionByName(classes.select("class", F.col("class").alias("near"), F.lit(0.0).alias("distance")))
    pairs = rows.select("key", "class").join(kept, "class").join(
        targets.select(F.col("class").alias("near"), F.col("key").alias("other")), "near"
    ).where("key <> other")
    last = Window.partitionBy("key").orderBy("distance", "other")
    return pairs.select("key", "other", "distance", F.row_number().over(last).alias("rank")).where(F.col("rank") <= k)
