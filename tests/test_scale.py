"""Ways that used to end at a limit, against brute force with their bounds set low."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import vectors as vec
from folioscope.operators import author_ids, evaluation, graph, interpretation, manifold, scoring


def tau_b(rows):
    s = nx = ny = 0
    for (_, a, b), (_, c, d) in itertools.combinations(rows, 2):
        x, y = np.sign(a - c), np.sign(b - d)
        s, nx, ny = s + x * y, nx + abs(x), ny + abs(y)
    return s / np.sqrt(nx * ny)


@pytest.mark.parametrize("ranges", [2, 5, 128])
@pytest.mark.parametrize("ties", [3, 40, 10_000])
def test_kendall_tau_over_ranges(spark, monkeypatch, ranges, ties):
    monkeypatch.setattr(scoring, "TAU_RANGES", ranges)
    rng = random.Random(ties)
    rows = []
    for i in range(300):
        x = rng.randrange(ties)
        rows.append((i, float(x), float(x // 2 + rng.randrange(ties))))
    rows += [(1000 + i, 1.0, float(i % 7)) for i in range(120)]  # a frequent score
    a = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(-1, None)], "id int, score double")
    b = spark.createDataFrame([(i, y) for i, _, y in rows] + [(-1, 2.0), (-2, 3.0)], "id int, score double")
    assert scoring.kendall_tau(a, b, "id").first()[0] == pytest.approx(tau_b(rows))


def test_kendall_tau_without_order(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, score double")
    assert scoring.kendall_tau(a, a, "id").first()[0] is None
    assert scoring.kendall_tau(a.limit(0), a, "id").first()[0] is None


def test_top_percent_by_rank(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(250)], "id int, score int").repartition(7)
    want = sorted(((i, i // 3) for i in range(250)), key=lambda r: (-r[1], r[0]))[:25]
    assert sorted(tuple(r) for r in scoring.top_percent(df, "id", 10).collect()) == sorted(want)
    assert scoring.top_percent(df.limit(0), "id").count() == 0


def test_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (30, 3))])
    labels = ["a"] * 40 + ["b"] * 30
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(70):
        own, other = [j for j in range(70) if labels[j] == labels[i] and j != i], [j for j in range(70) if labels[j] != labels[i]]
        a, b = d[i, own].mean(), d[i, other].mean()
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "k int, v array<double>, l string")
    monkeypatch.setattr(evaluation, "SILHOUETTE_ROWS", 16)
    assert evaluation.silhouette(df, "k", "v", "l").first()[0] == pytest.approx(np.mean(want))


def cliques(n, size):
    rows = [(c * size + i, c * size + j) for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return rows + [(c * size, ((c + 1) % n) * size + 1) for c in range(n)]


def test_louvain_contracts_on_the_cluster(spark):
    rows = cliques(12, 6)
    df = spark.createDataFrame([(min(r), max(r)) for r in rows] + [(3, 3)], "src bigint, dst bigint")
    for links in (10_000, 60):  # all on the driver; contracted first
        got = {}
        for r in graph.louvain(df, driver_links=links).collect():
            got.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, got.values())) == [list(range(c * 6, c * 6 + 6)) for c in range(12)]
    assert graph.louvain(df.limit(0)).count() == 0


def test_leaders_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(200)} | set(zip(names[:30], names[1:31])))
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = {}
    for name in names:
        if name not in want:
            want[name] = name
            for other in sorted(near.get(name, [])):
                want.setdefault(other, name)
    table = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    monkeypatch.setattr(author_ids, "similar_names", lambda names, threshold: table)
    got = {r.name: r.leader for r in author_ids.name_leaders(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_hellinger_pairs_of_dense_topics(spark, monkeypatch):
    monkeypatch.setattr(manifold, "GROUP_ENTRIES", 50)
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(30), 8)
    rows = [(t, f"w{w}", float(p[t, w] * (t + 1))) for t in range(8) for w in range(30)] + [(8, "own", 1.0)]
    got = {(r.i, r.j): r.distance for r in manifold.hellinger_pairs(spark.createDataFrame(rows, "topic int, term string, p double")).collect()}
    want = {(i, j): np.sqrt(max(0, 1 - np.sqrt(p[i] * p[j]).sum())) for i, j in itertools.combinations(range(8), 2)}
    assert got == pytest.approx(want)


def test_trajectory_by_rounds(spark):
    rng = random.Random(9)
    rows = sorted({(min(a, b), max(a, b)): rng.random() for a, b in (rng.sample(range(40), 2) for _ in range(90))}.items())
    df = spark.createDataFrame([(a, b, d) for (a, b), d in rows], "i int, j int, distance double")
    near = interpretation.trajectory(df, rows[0][0][0], rows[-1][0][1])
    far = interpretation.trajectory(df, rows[0][0][0], rows[-1][0][1], driver_edges=5)
    assert near[0] == pytest.approx(far[0]) and near[1] == far[1]
    assert interpretation.trajectory(df, 1, 99, driver_edges=5) == (float("inf"), [])


def test_entropies_of_rows(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],)], "v array<double>")
    assert vec.mean_entropy(df, "v").first()[0] == pytest.approx(np.log(2) / 2, abs=1e-6)
    w = np.array([0.5 * 0.5 + 1.0, 0.25])
    w /= w.sum()
    assert vec.entropy_of_max_weighted_mean(df, "v").first()[0] == pytest.approx(-(w * np.log2(w)).sum())
    assert vec.mean_entropy(df.limit(0), "v").first()[0] is None


def test_kernels_take_each_sum_once(spark):
    rng = np.random.default_rng(6)
    p, q = rng.random(200), rng.random(200)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    a, b = p / p.sum(), q / q.sum()
    row = df.select(vec.hellinger("p", "q").alias("h"), vec.kl_divergence("p", "q").alias("k"), vec.gini("p").alias("g"), vec.cosine("p", "q").alias("c"), F.get(vec.unit("p"), F.lit(3)).alias("u")).first()
    assert row.h == pytest.approx(np.sqrt(((np.sqrt(a) - np.sqrt(b)) ** 2).sum() / 2)) and row.k == pytest.approx((a * np.log(a / b)).sum())
    x = np.sort(p)
    assert row.g == pytest.approx(((2 * np.arange(1, 201) - 201) * x).sum() / (200 * x.sum()))
    assert row.c == pytest.approx(p @ q / np.linalg.norm(p) / np.linalg.norm(q)) and row.u == pytest.approx(p[3] / np.linalg.norm(p))


def test_kernels_in_sql_text_and_density(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(rng.random(8).tolist(), rng.random(8).tolist()) for _ in range(5)] + [([0.0] * 8, [0.0] * 8)], "p array<double>, q array<double>")
    names = vec.register_kernels(spark)
    assert "vec_hellinger" in names
    df.createOrReplaceTempView("two_vectors")
    for name in names:
        plain = vec.kernel(name.removeprefix("vec_"))
        rows = spark.table("two_vectors").selectExpr("p", "q", f"{name}(p, q) AS s").withColumn("c", plain("p", "q")).collect()
        assert [r.s for r in rows] == pytest.approx([r.c for r in rows])
    some = df.limit(5)
    assert vec.density(some, "p", vec.cosine, vec.max_weighted_mean).first()[0] > vec.density(some, "p").first()[0] * 0
