"""Name linking and vector search against brute force on small tables."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from folioscope.llm import name_variants as nv
from folioscope.llm import similar_vectors as sv
from folioscope.llm.graph_labels import component_labels


def true_distance(a, b):
    """Unrestricted Damerau-Levenshtein by its recurrence."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, c = last.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            if same:
                column = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, c - 1] + (i - k - 1) + 1 + (j - c - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distances():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    for p in words[:20]:
        assert nv.edit_distances(words, p).tolist() == [true_distance(w, p) for w in words]
    for a, b in itertools.combinations(words, 2):
        assert nv.within_one(a, b) == (true_distance(a, b) <= 1)


@pytest.mark.parametrize("radius", [1, 2])
def test_close_keys_loses_no_pair(spark, radius):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 6))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in words + [None] + words[:5]], "key string")
    got = {tuple(r) for r in nv.close_keys(df, radius, 8).collect()}
    assert got == {(a, b) for a in words for b in words if true_distance(a, b) <= radius}


def test_cells_are_parted_level_after_level(spark, monkeypatch):
    monkeypatch.setattr(nv, "CELL_STRINGS", 10)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "key string")
    got = {tuple(r) for r in nv.close_keys(df, 1, 8).collect()}
    assert got == {(a, b) for a in words for b in words if true_distance(a, b) <= 1}


def linked(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "name_id bigint, author_names string, affiliation string")
    return {tuple(r) for r in nv.linked_pairs(nv.link_names(df)).collect()}


def test_organisations_meet_by_their_words(spark):
    names = ["Centre of River Dynamics", "Centre of Piver Dynamics", "Dynamics of River Centre", "Centre of Harbour Dynamics"]
    assert linked(spark, [(n, AFF) for n in names]) == {(0, 1), (0, 2), (1, 2)}


def test_short_middle_names_tell_people_apart(spark):
    names = ["Maria Ann Stone", "Maria Joy Stone", "Stone, Maria Ann", "Maria van der Weir", "Maria Weir", "Maria vna der Weir"]
    assert linked(spark, [(n, AFF) for n in names]) == {(0, 2), (3, 4), (3, 5), (4, 5)}


AFF = "University of Northam"
ROWS = [
    ("Northam University", ["Maria J. Stone", "Stone, Maria", "STONE, MARIA", "Maria Stoen", "Mária Stone", "MariaStone", "Stone M", "Dr. Maria Stone", "Stone Maria"]),
    (AFF, ["William Harcourt", "Bill Harcourt", "Harcourt, Wil.", "Wiliam Harcourt"]),
    (AFF, ["Center of River Dynamics", "Centre of River Dynamics", "Ctr. of River Dyn.", "River Dynamics Centre", "CRD", "The Centre of River Dynmics"]),
    (AFF, ["Peter Harcourt"]),
    ("Southam Institute of Technology", ["Maria Stone"]),
    ("Southam Inst. Tech.", ["Otto Weir", "Weir, O."]),
    (None, ["Otto Weir"]),  # the only Otto Weir there is
    (None, ["Maria Stone"]),  # could be either
    (None, ["Nora Lund", "Lund, Nora"]),
]
SAME = [(0,), (1,), (2,), (3,), (4,), (5, 6), (7,), (8,)]


def test_linking(spark):
    rows, want, n = [], [], 0
    groups = {}
    for g, (aff, names) in enumerate(ROWS):
        for name in names:
            rows.append((n, name, aff, "clash", None))
            groups[n] = next(i for i, s in enumerate(SAME) if g in s)
            n += 1
    # enough comma forms for given names to be known
    for i, first in enumerate(["Maria", "Otto", "Nora", "William", "Peter"] * 3):
        rows.append((1000 + i, f"Filler{'abcdefghijklmno'[i]}man, {first}", f"Place {i}", "clash", None))
    rows += rows[:3] + [(2000, None, AFF, "clash", None), (2001, "  ", AFF, "clash", None)]
    df = spark.createDataFrame(rows, "name_id bigint, author_names string, affiliation string, entity string, n_papers int").repartition(3)
    got = {tuple(r) for r in nv.linked_pairs(nv.link_names(df)).collect()}
    want = {(a, b) for a in groups for b in groups if a < b and groups[a] == groups[b]}
    assert got == want


FAR = "University of Southam"
# (spellings, pairs that belong together); each family name or organisation stands in one entry
MEETING = [
    ([("William Harcourt", AFF), ("Bill Harcourt", None)], {(0, 1)}),
    ([("Otto Weir", AFF), ("Weir", None)], {(0, 1)}),
    ([("Lindqvist", AFF), ("Otto Lindqvist", None)], {(0, 1)}),
    ([("Maria Sandhurst", AFF), ("Naria Sandhurst", None)], {(0, 1)}),
    ([("William Tanner", None), ("Bill Tanner", None), ("Tanner, W.", None), ("William Tannre", None)], set(itertools.combinations(range(4), 2))),
    ([("William Oldman", None), ("Wanda Oldman", None), ("Oldman, W.", None)], set()),
    ([("Bill Arkwright", AFF), ("William Arkwright", FAR), ("Bill Arkwright", None)], {(0, 2)}),
    ([("Bill Dunmore", AFF), ("Bill Dunmore", FAR), ("William Dunmore", None)], set()),
    # look alike in print, four letters apart as typed; each spelling is its own base
    ([("Otto Burnernclicliford", AFF), ("Otto Burnernclicliforx", AFF), ("Otto Bumemdidifore", AFF)], set(itertools.combinations(range(3), 2))),
    # a first letter moves a word in the sorted order; two words with one edit each
    ([("Centre of River Dynamics", AFF), ("Centre of River Xynamics", AFF)], {(0, 1)}),
    ([("Station of Forest Acoustics", AFF), ("Station of Norest Acuostics", AFF)], {(0, 1)}),
    ([("Museum of Glacier Maps", AFF), ("Museum of Blacier Naps", None), ("Museum of Naps", AFF)], {(0, 1)}),
    # other scripts and digits have no skeletons that are alike
    ([("Петров, Иван", AFF), ("Сидоров, Иван", AFF), ("Петроу, Иван", AFF), ("Петров, Иван", AFF)], {(0, 2), (0, 3), (2, 3)}),
    ([("123", AFF), ("456", AFF)], set()),
]


def test_all_that_fits_meets(spark):
    rows, want = [], set()
    for names, pairs in MEETING:
        want |= {(a + len(rows), b + len(rows)) for a, b in pairs}
        rows += names
    rows += [(f"Filler{'abcdefghi'[i]}man, {first}", f"Place {i}") for i, first in enumerate(["Maria", "Otto", "William"] * 3)]
    assert linked(spark, rows) == want


def test_given_names_that_agree_share_a_letter():
    rng = random.Random(6)
    listed = sorted(nv.SHORT)
    typed = [w[:i] + rng.choice(["", "x", w[i] + "q", w[i + 1 : i + 2] + w[i]]) + w[i + 1 :] for w in listed for i in (0, 1)]
    names = [(w, 2) for w in listed + typed if len(w) > 1] + [(w[:n], n - 1 and 1) for w in listed for n in (1, 3)]
    agreeing = 0
    for (a, grade_a), (b, grade_b) in itertools.combinations(rng.sample(names, 900), 2):
        if nv.agree("p", a, "", grade_a, False, b, "", grade_b, False) or nv.agree("p", b, "", grade_b, False, a, "", grade_a, False):
            agreeing += 1
            assert set(nv.given_letters(a)) & set(nv.given_letters(b)), (a, b)
    assert agreeing > 1_000


def test_no_names(spark):
    df = spark.createDataFrame([], "name_id bigint, author_names string, affiliation string")
    assert nv.linked_pairs(nv.link_names(df)).count() == 0


def test_labels_of_a_long_chain(spark):
    nodes = spark.range(200)
    edges = spark.createDataFrame([(i + 1, i) for i in range(149)], "a bigint, b bigint")
    got = {r.id: r.label for r in component_labels(nodes, edges).collect()}
    assert got == {i: 0 if i < 150 else i for i in range(200)}


def clustered(n=400, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.dirichlet(np.full(dims, 0.3), 40)
    x = np.array([rng.dirichlet(centres[i % 40] * 400 + 1e-3) for i in range(n)])
    x[5] = x[4]
    x[n - 40 : n - 10] = x[n - 41]  # many exact copies
    return x


def brute_neighbours(x, k, most):
    s = np.sqrt(x)
    d = np.sqrt(np.maximum(0, 1 - s @ s.T))
    for i in range(len(x)):
        d[i, (x == x[i]).all(axis=1)] = 0
    out = {}
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i and d[i, j] <= most)[:k]
        out[i] = [(j, r + 1) for r, (_, j) in enumerate(order)]
    return out


def test_search_equals_brute_force(spark):
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, v array<double>").repartition(3)
    got = {}
    for r in sv.similar_distributions(df, 10, 0.15).collect():
        got.setdefault(r.key, []).append((r.other, r.rank))
    want = brute_neighbours(x, 10, 0.15)
    true = {(i, j) for i, v in want.items() for j, _ in v}
    have = {(i, j) for i, v in got.items() for j, _ in v}
    assert len(true) > 500 and len(true & have) / len(true) > 0.99 and len(have - true) <= 0.01 * len(true)


def test_leaves_and_travelling_queries(spark, monkeypatch):
    monkeypatch.setattr(sv, "LEAF_VECTORS", 30)
    monkeypatch.setattr(sv, "BLOCK_QUERIES", 20)
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, v array<double>").repartition(3)
    have = {(r.key, r.other) for r in sv.similar_distributions(df, 10, 0.15).collect()}
    true = {(i, j) for i, v in brute_neighbours(x, 10, 0.15).items() for j, _ in v}
    assert len(true & have) / len(true) > 0.97


def test_a_crowd_of_near_vectors(spark, monkeypatch):
    """A third of all vectors lie within the radius of each other: links stay few and neighbours are found."""
    monkeypatch.setattr(sv, "LEAF_VECTORS", 60)
    rng = np.random.default_rng(9)
    base = rng.dirichlet(np.full(16, 0.3), 400)
    crowd = np.abs(base[0] + rng.normal(0, 0.002, (200, 16)))
    x = np.concatenate([base, crowd])
    x /= x.sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, v array<double>").repartition(3)
    have = {}
    for r in sv.similar_distributions(df, 5, 0.15).collect():
        have.setdefault(r.key, set()).add(r.other)
    want = {i: {j for j, _ in v} for i, v in brute_neighbours(x, 5, 0.15).items()}
    true = sum(map(len, want.values()))
    assert sum(map(len, have.values())) == true and sum(len(want[i] & have.get(i, set())) for i in want) / true > 0.95


@pytest.mark.parametrize("alpha", [1.0, 0.2, 0.02])
def test_recall_of_the_tree_on_dense_and_peaked_vectors(alpha):
    """Pairs at the radius and nearer, by brute force; both ways of a pair count, as in the search."""
    rng = np.random.default_rng(4)
    radius = 0.15 * np.sqrt(2)
    base = np.sqrt(rng.dirichlet(np.full(64, alpha), 8_000))
    near = base[:2_000] + rng.normal(0, 0.14 / 8, (2_000, 64))
    v = np.concatenate([base, np.abs(near) / np.linalg.norm(near, axis=1, keepdims=True)]).astype(np.float32)
    tree = sv.fit_tree(v[rng.permutation(len(v))[:4_000]], 60, sv.MARGIN * radius, 7)
    row, leaf = sv.route(tree, v, sv.MARGIN * radius)
    home_row, home_leaf = sv.route(tree, v)
    home = np.empty(len(v), int)
    home[home_row] = home_leaf
    reached = set(zip(row.tolist(), leaf.tolist()))
    pairs = np.argwhere(np.triu(v @ v.T >= 1 - radius**2 / 2, 1))
    assert len(pairs) > 1_500 and len(home_row) == len(v) and np.bincount(home_leaf).max() < 400
    assert np.mean([(a, home[b]) in reached or (b, home[a]) in reached for a, b in pairs.tolist()]) > 0.99


def test_collision_counting_equals_brute_force():
    rng = np.random.default_rng(8)
    v = np.sqrt(rng.dirichlet(np.full(20, 0.1), 1_500)).astype(np.float32)
    got = {(int(a), int(b)) for q, x, _ in sv.collision_search(v[:700], v, 0.3, 10_000) for a, b in zip(q, x)}
    distance = np.sqrt(np.maximum(0, 2 - 2 * v[:700].astype(float) @ v.T.astype(float)))
    true = {tuple(p) for p in np.argwhere(distance <= 0.3).tolist()}
    assert len(true) > 700 and len(got & true) / len(true) > 0.99 and not {p for p in got if distance[p] > 0.301}


def test_usable_rows(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [(1, [1.0, 1.0], t(1)), (1, [0.0, 3.0], t(2)), (2, None, t(1)), (3, [], t(1)), (4, [0.0, 0.0], t(1)), (5, [1.0, None], t(1)), (6, [float("nan"), 1.0], t(1)), (None, [1.0], t(1)), (7, [2.0, 2.0], t(1)), (7, None, t(3))]
    df = spark.createDataFrame(rows, "a bigint, p array<float>, ts timestamp")
    assert [(r.key, r.v) for r in sv.usable_distributions(df, "a", "ts", "p").collect()] == [(1, [0.0, 1.0])]
    assert sv.similar_distributions(sv.usable_distributions(df.limit(0), "a", "ts", "p"), 10, 0.15).count() == 0
