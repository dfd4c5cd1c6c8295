"""Vector kernels as column expressions: distances, similarities and statistics of array columns.

Null vectors give null; vectors of different length are compared as if the shorter one ended in nulls, which
count as 0. Empty vectors have distance 0 and similarity 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.bind import let

FLOOR = 1e-10


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def _sum2(p: Column | str, q: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    zero = F.lit(0.0)
    return total(F.zip_with(_c(p), _c(q), lambda a, b: f(F.coalesce(a.cast("double"), zero), F.coalesce(b.cast("double"), zero))))


def normalised(v: Column | str) -> Column:
    """Divided by the sum where that is positive, else unchanged."""
    return let(_scale(v), lambda s: F.transform(_c(v), lambda x: x.cast("double") / s))


def _scale(v: Column | str) -> Column:
    """The sum where that is positive, else 1."""
    return let(total(v), lambda s: F.when(s > 0, s).otherwise(1.0))


def _shares(p: Column | str, q: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the entries of both normalised vectors; each sum is taken once."""
    return let(F.struct(_scale(p).alias("p"), _scale(q).alias("q")), lambda s: _sum2(p, q, lambda a, b: f(a / s["p"], b / s["q"])))


def unit(v: Column | str) -> Column:
    """Divided by the Euclidean norm; a zero vector stays."""
    norm = F.sqrt(_squares(v))
    return let(norm, lambda n: F.transform(_c(v), lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def _squares(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0)))


def hellinger(p: Column | str, q: Column | str) -> Column:
    """Of the normalised vectors; in [0, 1]."""
    return F.sqrt(0.5 * _shares(p, q, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2)))


def hellinger_similarity(p: Column | str, q: Column | str) -> Column:
    return 1 - hellinger(p, q)


def hellinger_decay(p: Column | str, q: Column | str, alpha: float = 10.0) -> Column:
    """1 / (1 + alpha * distance)."""
    return 1 / (1 + alpha * hellinger(p, q))


def euclidean(p: Column | str, q: Column | str) -> Column:
    return F.sqrt(_sum2(p, q, lambda a, b: (a - b) * (a - b)))


def manhattan(p: Column | str, q: Column | str) -> Column:
    return _sum2(p, q, lambda a, b: F.abs(a - b))


def cosine(p: Column | str, q: Column | str) -> Column:
    """0 where either vector is zero."""
    norms = F.sqrt(_squares(p)) * F.sqrt(_squares(q))
    return let(norms, lambda n: F.when(n > 0, _sum2(p, q, lambda a, b: a * b) / n).otherwise(0.0))


def kl_divergence(p: Column | str, q: Column | str) -> Column:
    """Natural logarithm, normalised vectors, over places where both are positive."""
    return _shares(p, q, lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / b)).otherwise(0.0))


def jensen_shannon(p: Column | str, q: Column | str) -> Column:
    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        left = F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
        right = F.when(b > 0, b * F.log(b / m)).otherwise(0.0)
        return (left + right) / 2

    return _shares(p, q, part)


def bhattacharyya(p: Column | str, q: Column | str) -> Column:
    floor = F.lit(FLOOR)
    return -F.log(_sum2(p, q, lambda a, b: F.sqrt(F.greatest(a, floor) * F.greatest(b, floor))))


def variation_by_min(p: Column | str, q: Column | str) -> Column:
    return _sum2(p, q, lambda a, b: F.abs(a - b) * F.least(a, b))


def variation_by_mean(p: Column | str, q: Column | str) -> Column:
    return _sum2(p, q, lambda a, b: F.abs(a - b) * (a + b) / 2)


def inverse_l1(p: Column | str, q: Column | str) -> Column:
    """1 / L1 distance, 1 where that is (almost) 0."""
    return let(manhattan(p, q), lambda d: F.when(d > FLOOR, 1 / d).otherwise(1.0))


def entropy_bits(p: Column | str) -> Column:
    """Base 2 over the positive entries, without normalisation."""
    return -total(F.transform(_c(p), lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def entropy_nats(p: Column | str) -> Column:
    """Natural logarithm with entries floored at 1e-10."""
    return -total(F.transform(_c(p), lambda x: F.greatest(x.cast("double"), F.lit(FLOOR)) * F.log(F.greatest(x.cast("double"), F.lit(FLOOR)))))


def gini(p: Column | str) -> Column:
    """Of the non-zero entries; 0 if there are none."""

    def of(x: Column) -> Column:
        def ratio(s: Column) -> Column:
            weighted = total(F.transform(x, lambda v, i: (2 * (i + 1) - s["n"] - 1) * v))
            return F.when((s["n"] > 0) & (s["t"] != 0), weighted / (s["n"] * s["t"])).otherwise(0.0)

        return let(F.struct(F.size(x).alias("n"), total(x).alias("t")), ratio)

    return let(F.array_sort(F.filter(_c(p), lambda v: v != 0)), of)


def mean_entropy(df: DataFrame, vector: str) -> DataFrame:
    """One row ``mean_entropy``: mean of the rows' entropies in nats; null for an empty table."""
    return df.agg(F.avg(entropy_nats(vector)).alias("mean_entropy"))


def entropy_of_max_weighted_mean(df: DataFrame, vector: str) -> DataFrame:
    """One row ``entropy``: entropy in bits of ``max_weighted_mean``."""
    x = F.col("x")
    return max_weighted_mean(df, vector).agg((-F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0))).alias("entropy"))


def argmax(p: Column | str) -> Column:
    """Index from 0 of the first largest entry."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


KERNELS: dict[str, Callable[[Column | str, Column | str], Column]] = {
    "hellinger": hellinger, "hellinger_similarity": hellinger_similarity, "hellinger_decay": hellinger_decay, "euclidean": euclidean,
    "manhattan": manhattan, "cosine": cosine, "kl": kl_divergence, "js": jensen_shannon, "bhattacharyya": bhattacharyya,
    "tv_min": variation_by_min, "tv_mean": variation_by_mean, "inverse_l1": inverse_l1,
}


def kernel(name: str) -> Callable[[Column | str, Column | str], Column]:
    """A kernel by name; ValueError for an unknown one."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(sorted(KERNELS))}")
    return KERNELS[name]


# ---- over rows ------------------------------------------------------------------------------------------------


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, x) of the entries that are not null."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).where(F.col("x").isNotNull()).select(key, "pos", F.col("x").cast("double").alias("x"))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """(pos, x): element-wise mean of all vectors; one compact state per place and partition is shuffled."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


def max_weighted_mean(df: DataFrame, vector: str) -> DataFrame:
    """(pos, x): vectors weighted by their largest entry, summed and normalised to 1."""
    weighted = df.select(F.array_max(vector).alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = weighted.groupBy("pos").agg(F.sum(F.col("x").cast("double") * F.col("w").cast("double")).alias("s"))
    all_ = sums.agg(F.sum("s").alias("t"))  # one row
    return sums.join(F.broadcast(all_)).select("pos", F.try_divide("s", "t").alias("x"))


def mean_pairwise_cosine(df: DataFrame, vector: str) -> DataFrame:
    """One row ``mean_cosine``: the mean over all pairs of different rows, from one pass over unit vectors:
    (|sum|^2 - n) / (n (n - 1)). Zero vectors count as vectors of length 0; fewer than two rows give null."""
    units = df.select(unit(vector).alias("u"))
    n = units.agg(F.count(F.lit(1)).alias("n"), F.sum(_sum2("u", "u", lambda a, b: a * b)).alias("own"))
    sums = units.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    both = n.join(F.broadcast(sums))  # one row each
    return both.select(F.when(F.col("n") > 1, (F.col("sq") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def density(df: DataFrame, vector: str, similarity: Callable[[Column | str, Column | str], Column] = inverse_l1, centroid: Callable[[DataFrame, str], DataFrame] = mean_vector) -> DataFrame:
    """One row ``density``: mean similarity to the centroid; by default of 1 / L1 distance (1 where that is almost 0) to the
    mean vector. ``centroid`` gives (pos, x), as ``mean_vector`` and ``max_weighted_mean`` do; any kernel will do."""
    centre = centroid(df, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))  # one vector
    centre = centre.select(F.col("c.x").alias("centre"))
    return df.join(F.broadcast(centre)).agg(F.avg(similarity(vector, "centre")).alias("density"))


# The kernels as SQL expressions of two arrays p and q; {P} and {Q} are the arrays divided by their sums.
_SQL_KERNELS = {
    "hellinger": "sqrt(0.5 * aggregate(zip_with({P}, {Q}, (a, b) -> power(sqrt(a) - sqrt(b), 2)), 0D, (s, x) -> s + x))",
    "euclidean": "sqrt(aggregate(zip_with(p, q, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))",
    "manhattan": "aggregate(zip_with(p, q, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x)",
    "cosine": "coalesce(try_divide(aggregate(zip_with(p, q, (a, b) -> a * b), 0D, (s, x) -> s + x),"
    " sqrt(aggregate(p, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(q, 0D, (s, x) -> s + x * x))), 0D)",
    "kl": "aggregate(zip_with({P}, {Q}, (a, b) -> IF(a > 0 AND b > 0, a * ln(a / b), 0D)), 0D, (s, x) -> s + x)",
    "js": "aggregate(zip_with({P}, {Q}, (a, b) -> (IF(a > 0, a * ln(2 * a / (a + b)), 0D) + IF(b > 0, b * ln(2 * b / (a + b)), 0D)) / 2), 0D, (s, x) -> s + x)",
}


def register_kernels(spark: SparkSession, prefix: str = "vec_") -> list[str]:
    """Makes kernels callable in SQL text as temporary functions of two ARRAY<DOUBLE> of one length (vec_hellinger, ...); they
    are SQL expressions, so the optimizer sees through them. Their names."""
    share = "transform({0}, x -> coalesce(try_divide(x, aggregate({0}, 0D, (s, y) -> s + y)), x))"
    for name, body in _SQL_KERNELS.items():
        text = body.replace("{P}", "np").replace("{Q}", "nq")
        inner = f"(SELECT {text} FROM (SELECT p, q, {share.format('p')} AS np, {share.format('q')} AS nq))" if "np" in text else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {inner}")
    return [prefix + name for name in _SQL_KERNELS]
