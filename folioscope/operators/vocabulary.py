"""Vocabulary: document frequencies, frequency and stopword filters, bags of words, term relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.numbering import numbered


def term_frequencies(df: DataFrame, doc: str, tokens: Column | str) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences; pre-aggregated per document and partition."""
    per_doc = df.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def bag_of_words(df: DataFrame, doc: str, tokens: Column | str) -> DataFrame:
    """(doc, term, n)."""
    return df.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))


def approved_terms(frequencies: DataFrame, n_docs: int, low: int = 1, high: float = 0.995, stop: list[str] | None = None, shortest: int = 3) -> DataFrame:
    """Terms with low < df <= floor(n_docs * high), at least ``shortest`` characters and not in ``stop``."""
    kept = frequencies.where((F.col("df") > low) & (F.col("df") <= int(n_docs * high)) & (F.length("term") >= shortest))
    return kept.where(~F.col("term").isin(stop)) if stop else kept


def keep_terms(df: DataFrame, doc: str, tokens: str, terms: DataFrame) -> DataFrame:
    """(doc, tokens) with only the tokens in ``terms`` (column term), in their order, repeats kept. Documents left
    without tokens are dropped. The join is by term; each document is put together again on its own."""
    rows = df.select(doc, F.posexplode(tokens).alias("pos", "term")).join(terms.select("term"), "term", "left_semi")
    ordered = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return ordered.select(doc, F.col("t.term").alias(tokens))


def numbered_terms(frequencies: DataFrame) -> DataFrame:
    """(term, df, cf, term_id): ids by falling df, then term."""
    return numbered(frequencies, [F.desc("df"), "term"], "term_id")


def relevance(weights: DataFrame, lam: float = 0.6, floor: float = 1e-12) -> DataFrame:
    """(topic, term, relevance) for (topic, term, weight): lam * ln p(w|t) + (1 - lam) * (ln p(w|t) - ln p(w)), with
    p(w) from the weights over all topics."""
    if not 0 <= lam <= 1:
        raise ValueError("lam must lie in [0, 1]")
    per_topic = weights.groupBy("topic").agg(F.sum("weight").alias("t"))
    per_term = weights.groupBy("term").agg(F.sum("weight").alias("w"))
    everything = weights.agg(F.sum("weight").alias("s"))  # one row
    joined = weights.join(per_topic, "topic").join(per_term, "term").join(F.broadcast(everything))
    p = F.greatest(F.col("weight") / F.col("t"), F.lit(floor))
    q = F.greatest(F.col("w") / F.col("s"), F.lit(floor))
    return joined.select("topic", "term", (lam * F.log(p) + (1 - lam) * (F.log(p) - F.log(q))).alias("relevance"))


def contrastive_relevance(weights: DataFrame, inside: list, lam: float = 0.6, floor: float = 1e-12) -> DataFrame:
    """(term, relevance) of a cluster of topics: as ``relevance``, with p(w) from the topics outside the cluster."""
    flag = F.col("topic").isin(inside)
    sums = weights.groupBy("term").agg(F.sum(F.when(flag, F.col("weight")).otherwise(0)).alias("i"), F.sum(F.when(flag, 0).otherwise(F.col("weight"))).alias("o"))
    all_ = sums.agg(F.sum("i").alias("si"), F.sum("o").alias("so"))  # one row
    joined = sums.where("i > 0").join(F.broadcast(all_))
    p = F.greatest(F.col("i") / F.col("si"), F.lit(floor))
    q = F.greatest(F.col("o") / F.col("so"), F.lit(floor))
    return joined.select("term", (lam * F.log(p) + (1 - lam) * (F.log(p) - F.log(q))).alias("relevance"))


def top_terms(scores: DataFrame, n: int, score: str = "relevance", by: str = "topic") -> DataFrame:
    """The ``n`` best terms per group with their rank; ties by term. Only n rows per group and partition move."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "term"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)
