"""Topic model evaluation: coherence from document co-occurrence, diversity, silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpointed


def topic_diversity(top: DataFrame, k: int = 10) -> DataFrame:
    """One row ``diversity``: distinct terms / terms among the first k of each topic (topic, term, rank); 0 if empty."""
    first = top.where(F.col("rank") <= k)
    n = F.count(F.lit(1))
    return first.agg(F.when(n > 0, F.count_distinct("term") / n).otherwise(0.0).alias("diversity"))


def term_pairs(top: DataFrame, doc_terms: DataFrame, doc: str) -> DataFrame:
    """(topic, a, b, rank_a, rank_b, df_a, df_b, df_ab), rank_a < rank_b: document counts of the pairs of each topic's
    top terms. Only top terms are joined, so a document gives few pairs."""
    wanted = top.select("term").distinct()
    seen = doc_terms.select(doc, "term").distinct().join(wanted, "term", "left_semi")
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pairs = top.alias("x").join(top.alias("y"), F.col("x.topic") == F.col("y.topic")).where("x.rank < y.rank")
    pairs = pairs.select(F.col("x.topic").alias("topic"), F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.rank").alias("rank_a"), F.col("y.rank").alias("rank_b"))
    needed = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = seen.select(doc, F.col("term").alias("a")).join(seen.select(doc, F.col("term").alias("b")), doc).where("a < b")
    joint = both.join(needed, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("df_ab"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    out = pairs.withColumn("lo", lo).withColumn("hi", hi).join(joint.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "df_ab"), ["lo", "hi"], "left")
    out = out.join(df.select(F.col("term").alias("a"), F.col("df").alias("df_a")), "a", "left").join(df.select(F.col("term").alias("b"), F.col("df").alias("df_b")), "b", "left")
    return out.select("topic", "a", "b", "rank_a", "rank_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("df_a", "df_b", "df_ab")])


def umass(pairs: DataFrame) -> DataFrame:
    """(topic, coherence): mean of ln((df_ab + 1) / df_a), a being the better ranked term."""
    value = F.when(F.col("df_a") > 0, F.log((F.col("df_ab") + 1) / F.col("df_a")))
    return pairs.groupBy("topic").agg(F.avg(value).alias("coherence"))


def npmi(pairs: DataFrame, n_docs: int, eps: float = 1e-12) -> DataFrame:
    """(topic, coherence): mean normalised pointwise mutual information over documents."""
    p, a, b = F.col("df_ab") / n_docs + eps, F.col("df_a") / n_docs, F.col("df_b") / n_docs
    value = F.when((F.col("df_a") > 0) & (F.col("df_b") > 0), F.log(p / (a * b)) / -F.log(p))
    return pairs.groupBy("topic").agg(F.avg(value).alias("coherence"))


def uci(pairs: DataFrame, n_docs: int, eps: float = 1e-12) -> DataFrame:
    """(topic, coherence): mean pointwise mutual information over documents."""
    p, a, b = F.col("df_ab") / n_docs + eps, F.col("df_a") / n_docs, F.col("df_b") / n_docs
    return pairs.groupBy("topic").agg(F.avg(F.when((F.col("df_a") > 0) & (F.col("df_b") > 0), F.log(p / (a * b)))).alias("coherence"))


#: Rows of one side of a block of the silhouette.
SILHOUETTE_ROWS = 5_000


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """One row ``silhouette``: exact Euclidean silhouette; 0 for a single label. Rows alone in their label count 0.

    The measure is defined over the distances of all rows to all rows. They are taken in blocks of numpy arrays and leave
    each block as one sum per row and label, so time grows with the square of the rows and tables with rows times blocks."""
    rows = df.select(key, F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l"))
    blocks = max(1, -(-rows.count() // SILHOUETTE_ROWS))
    side = F.pmod(F.xxhash64(key), F.lit(blocks))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select(F.lit(True).alias("asks"), key, "v", "l", side.alias("i"), F.explode(every).alias("j"))
    right = rows.select(F.lit(False).alias("asks"), key, "v", "l", F.explode(every).alias("i"), side.alias("j"))

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        ask, hold = frame[frame["asks"]], frame[~frame["asks"]]
        if not len(ask) or not len(hold):
            return pd.DataFrame({key: [], "own": [], "other": [], "total": [], "n": []})
        a, b = np.stack(ask["v"]), np.stack(hold["v"])
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))
        out = []
        for lab in hold["l"].unique():
            mask = (hold["l"] == lab).to_numpy()
            out.append(pd.DataFrame({key: ask[key], "own": ask["l"], "other": lab, "total": d[:, mask].sum(axis=1), "n": int(mask.sum())}))
        return pd.concat(out)

    kind = dict(rows.dtypes)[key]
    part = left.unionByName(right).groupBy("i", "j").applyInPandas(sums, f"{key} {kind}, own string, other string, total double, n bigint")
    mean = part.groupBy(key, "own", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    a = F.max(F.when(F.col("own") == F.col("other"), F.when(F.col("n") > 1, F.col("t") / (F.col("n") - 1))))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("t") / F.col("n")))
    s = mean.groupBy(key).agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return s.agg(F.avg(value).alias("silhouette"))


def window_pairs(top: DataFrame, docs: DataFrame, doc: str, tokens: str, size: int = 110) -> tuple[DataFrame, int]:
    """(as ``term_pairs`` over sliding windows instead of documents, number of windows). A document of up to ``size`` tokens
    is one window, a longer one has one for each start.

    Windows are never formed: a token lies in the windows of one range of starts, a term in the union of its tokens'
    ranges, and two terms in the overlaps of their unions."""
    wanted = top.select("term").distinct()
    starts = F.greatest(F.size(tokens) - size, F.lit(0))  # the last start
    seen = docs.where(F.size(tokens) > 0).select(doc, starts.alias("last"), F.posexplode(tokens).alias("at", "term")).join(wanted, "term", "left_semi")
    total = docs.where(F.size(tokens) > 0).agg(F.coalesce(F.sum(starts + 1), F.lit(0))).first()[0]
    ranges = seen.select(doc, "term", F.greatest(F.col("at") - size + 1, F.lit(0)).alias("lo"), F.least("at", "last").alias("hi"))
    order = Window.partitionBy(doc, "term").orderBy("lo", "hi")
    gap = F.coalesce((F.col("lo") > F.lag("hi").over(order) + 1).cast("int"), F.lit(1))
    runs = ranges.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order)).groupBy(doc, "term", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = checkpointed(runs)
    df = runs.groupBy("term").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("df"))
    x, y = (runs.select(doc, F.col("term").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}")) for n in "ab")
    overlap = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") + 1
    joint = x.join(y, doc).where("a < b").withColumn("n", overlap).where("n > 0")
    pairs = top.alias("x").join(top.alias("y"), F.col("x.topic") == F.col("y.topic")).where("x.rank < y.rank")
    pairs = pairs.select(F.col("x.topic").alias("topic"), F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.rank").alias("rank_a"), F.col("y.rank").alias("rank_b"))
    needed = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joint = joint.join(needed, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("df_ab"))
    out = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(joint.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "df_ab"), ["lo", "hi"], "left")
    out = out.join(df.select(F.col("term").alias("a"), F.col("df").alias("df_a")), "a", "left").join(df.select(F.col("term").alias("b"), F.col("df").alias("df_b")), "b", "left")
    return out.select("topic", "a", "b", "rank_a", "rank_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("df_a", "df_b", "df_ab")]), int(total)


def c_v(pairs: DataFrame, n_windows: int, eps: float = 1e-12) -> DataFrame:
    """(topic, coherence): mean cosine of each top term's vector of normalised pointwise mutual information with all top
    terms and the sum of these vectors. Terms that occur nowhere have a zero vector, and a cosine with it is 0."""

    def value(ab: str, a: str, b: str) -> Column:
        p = F.col(ab) / n_windows + eps
        return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(p / (F.col(a) / n_windows * F.col(b) / n_windows)) / -F.log(p)).otherwise(0.0)

    cells = pairs.select("topic", F.col("a").alias("i"), F.col("b").alias("j"), value("df_ab", "df_a", "df_b").alias("x"))
    own = pairs.select("topic", F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("df_a").alias("df")), F.struct(F.col("b").alias("i"), F.col("df_b").alias("df")))).alias("o")).select("topic", "o.i", "o.df").distinct()
    # a term that is in every window has no information; its own cell is 0 as its logarithm is
    diagonal = own.select("topic", "i", F.col("i").alias("j"), F.when((F.col("df") > 0) & (F.col("df") < n_windows), value("df", "df", "df")).otherwise(0.0).alias("x"))
    every = cells.unionByName(cells.select("topic", F.col("j").alias("i"), F.col("i").alias("j"), "x")).unionByName(diagonal)
    total = every.groupBy("topic", "j").agg(F.sum("x").alias("t"))
    length = total.groupBy("topic").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("whole"))
    per = every.join(total, ["topic", "j"]).groupBy("topic", "i").agg(F.sum(F.col("x") * F.col("t")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    cosine = F.coalesce(F.try_divide("dot", F.col("norm") * F.col("whole")), F.lit(0.0))
    return per.join(length, "topic").groupBy("topic").agg(F.avg(cosine).alias("coherence"))


def evaluation(top: DataFrame, theta: DataFrame, doc: str, coherence: DataFrame | None = None, perplexity: float | None = None, points: DataFrame | None = None) -> DataFrame:
    """One row: perplexity, coherence (mean over topics), diversity, silhouette, mean_entropy (nats) of a fitted model. What
    is not given or cannot be computed is 0. ``points``: key, v, label for the silhouette."""
    row = topic_diversity(top)
    per = theta.groupBy(doc).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("e"))
    row = row.join(F.broadcast(per.agg(F.avg("e").alias("mean_entropy"))))  # one row each
    row = row.join(F.broadcast(coherence.agg(F.avg("coherence").alias("coherence")))) if coherence is not None else row.withColumn("coherence", F.lit(0.0))
    row = row.join(F.broadcast(silhouette(points, "key", "v", "label"))) if points is not None else row.withColumn("silhouette", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return row.withColumn("perplexity", F.lit(perplexity or 0.0)).select(*[zero(c) for c in ("perplexity", "coherence", "diversity", "silhouette", "mean_entropy")])
