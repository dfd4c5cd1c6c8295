"""Author ids by fuzzy name matching: blocks of names, cosine of character trigrams, greedy leaders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import name_ngrams, standard_name
from folioscope.operators.numbering import numbered
from folioscope.session import checkpointed


def standard_names(papers: DataFrame, names: str = "author_names", longest: int = 20) -> DataFrame:
    """(name): the distinct standard names (see ``standard_name``) of at least two characters."""
    flat = papers.select(F.explode(names).alias("raw")).select(standard_name("raw", longest).alias("name"))
    return flat.where(F.length("name") >= 2).distinct()


def trigram_weights(names: DataFrame, n: int = 3, prefix: int = 2) -> DataFrame:
    """(block, name, gram, w): tf-idf weights of trigrams with unit length per name. The block is the name's first
    ``prefix`` characters; document frequencies are smoothed and taken within the block."""
    grams = names.select(F.substring("name", 1, prefix).alias("block"), "name", F.explode(name_ngrams("name", n)).alias("gram"))
    tf = grams.groupBy("block", "name", "gram").agg(F.count(F.lit(1)).alias("tf"))
    docs = names.groupBy(F.substring("name", 1, prefix).alias("block")).agg(F.count(F.lit(1)).alias("docs"))
    df = tf.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    raw = tf.join(df, ["block", "gram"]).join(docs, "block").select("block", "name", "gram", (F.col("tf") * idf).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("block", "name")))
    return raw.select("block", "name", "gram", (F.col("x") / norm).alias("w"))


#: Names of a block that one task compares with each other or with as many others.
NAMES_TOGETHER = 4_000
#: Cosines that a task holds at once.
CELLS = 1 << 20


def similar_names(names: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(block, a, b, similarity), a < b, of names in one block with a cosine above ``threshold``. A block is cut into parts
    of about NAMES_TOGETHER names and every two parts meet in one task, which adds up the products over shared trigrams;
    only pairs above the threshold become rows. A name travels once for each part of its block."""
    w = trigram_weights(names)
    rows = checkpointed(w.groupBy("block", "name").agg(F.collect_list(F.struct("gram", "w")).alias("g")))  # one name's trigrams
    size = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / NAMES_TOGETHER).cast("int").alias("parts"))
    parted = rows.join(size, "block").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sent = parted.select("block", "name", F.col("g.gram").alias("gram"), F.col("g.w").alias("w"), "part", other)
    sent = sent.select("block", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "name", "gram", "w")

    return sent.groupBy("block", "one", "two").applyInArrow(lambda key, group: _close_names(group, threshold), "block string, a string, b string, similarity double")


def _close_names(group: pa.Table, threshold: float) -> pa.Table:
    """Pairs of one meeting of two parts, or of a part with itself. Trigrams that many of the names have are multiplied as
    dense columns, the others from name to name."""
    one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
    side = group.column("part").to_numpy()
    rows, others = np.flatnonzero(side == one), np.flatnonzero(side == two)
    names, grams, weights = group.column("name"), group.column("gram").combine_chunks(), group.column("w").combine_chunks()
    owner = np.repeat(np.arange(len(names)), grams.value_lengths().to_numpy())
    term = pc.dictionary_encode(grams.flatten()).indices.to_numpy().astype(np.int64)
    value = weights.flatten().to_numpy()
    many = np.bincount(term) > len(names) / 64 + 8
    column = np.cumsum(many) - 1
    place = np.full(len(names), -1)
    place[others] = np.arange(len(others))
    common = many[term]
    entries = lambda keep: (owner[keep], term[keep], value[keep])
    wide = np.zeros((len(others), int(many.sum())))
    o, t, v = entries(common & (place[owner] >= 0))
    wide[place[o], column[t]] = v
    o, t, v = entries(~common & (place[owner] >= 0))
    order = np.argsort(t, kind="stable")
    holder, held = place[o[order]], v[order]
    begin = np.searchsorted(t[order], np.arange(len(many) + 1))
    step = max(1, CELLS // max(1, len(others)))
    left, right, score = [], [], []
    for first in range(0, len(rows), step):
        here = rows[first : first + step]
        at = np.full(len(names), -1)
        at[here] = np.arange(len(here))
        mine = at[owner] >= 0
        dense = np.zeros((len(here), wide.shape[1]))
        o, t, v = entries(common & mine)
        dense[at[o], column[t]] = v
        dots = dense @ wide.T
        o, t, v = entries(~common & mine)
        n = begin[t + 1] - begin[t]
        places = np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        dots += np.bincount(np.repeat(at[o], n) * len(others) + holder[places], np.repeat(v, n) * held[places], dots.size).reshape(dots.shape)
        x, y = np.nonzero(dots > threshold)
        x, y, dots = here[x], others[y], dots[x, y]
        kept = x < y if one == two else np.ones(len(x), bool)
        left.append(x[kept])
        right.append(y[kept])
        score.append(dots[kept])
    left, right, score = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right, score))
    pairs = [sorted(p) for p in zip(names.take(left).to_pylist(), names.take(right).to_pylist())]
    columns = [[group.column("block")[0].as_py()] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs], score]
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.float64()])], ["block", "a", "b", "similarity"])


MAX_ROUNDS = 200


def name_leaders(names: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(name, leader): greedy in the order of names - a name that is not taken leads and takes all similar names that
    are not taken yet (no transitive closure).

    Decided in rounds over all names at once: a name is taken as soon as a smaller similar name leads, and leads as soon
    as all of them are taken. No group goes through one task, whatever its size; there are as many rounds as the longest
    chain of decisions that hang on each other. RuntimeError after MAX_ROUNDS.
    """
    pairs = checkpointed(similar_names(names, threshold).select("a", "b"))  # a < b
    open_ = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    leads = open_.join(pairs.select(F.col("b").alias("name")), "name", "left_anti")
    decided = checkpointed(leads.select("name", F.lit(True).alias("leads")))
    waiting = checkpointed(pairs.where("a < b"))  # pairs whose larger name is not decided
    for _ in range(MAX_ROUNDS):
        state = waiting.join(decided.select(F.col("name").alias("a"), "leads"), "a", "left")
        per = state.groupBy("b").agg(F.max("leads").alias("led"), F.count_if(F.col("leads").isNull()).alias("unknown"))
        fresh = per.where("led OR unknown = 0").select(F.col("b").alias("name"), (~F.coalesce("led", F.lit(False))).alias("leads"))
        fresh = checkpointed(fresh.join(decided.select("name"), "name", "left_anti"))
        if fresh.limit(1).count() == 0:
            break
        decided = checkpointed(decided.unionByName(fresh))
        waiting = checkpointed(waiting.join(fresh.select(F.col("name").alias("b")), "b", "left_anti"))
    else:
        raise RuntimeError(f"names are still undecided after {MAX_ROUNDS} rounds")
    takers = pairs.join(decided.where("leads").select(F.col("name").alias("a")), "a").groupBy(F.col("b").alias("name")).agg(F.min("a").alias("leader"))
    return names.select("name").join(takers, "name", "left").select("name", F.coalesce("leader", "name").alias("leader"))


def author_map(names: DataFrame, threshold: float = 0.9, digits: int = 7, known: DataFrame | None = None) -> DataFrame:
    """(name, leader, author_id): ids of at least ``digits`` digits, the same for the same set of names. They follow the
    leaders' order. With ``known``, an earlier map, its names are kept, a group with known names has the smallest of their
    ids, and new ids begin after the largest one."""
    every = names.select("name") if known is None else names.select("name").unionByName(known.select("name")).distinct()
    leaders = checkpointed(name_leaders(checkpointed(every), threshold))
    first = 10 ** (digits - 1)
    if known is None:
        ids = numbered(leaders.select("leader").distinct(), ["leader"], "author_id", first)
        return leaders.join(ids, "leader").select("name", "leader", "author_id")
    old = leaders.join(known.select("name", "author_id"), "name", "left").groupBy("leader").agg(F.min("author_id").alias("old"))
    top = known.agg(F.max("author_id")).first()[0]
    ids = numbered(old.where("old IS NULL").select("leader"), ["leader"], "author_id", max(first, (top or 0) + 1))
    ids = ids.unionByName(old.where("old IS NOT NULL").select("leader", F.col("old").alias("author_id")))
    return leaders.join(ids, "leader").select("name", "leader", "author_id")


def sync_map(mapping: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, leader, author_id) after a look at ids that documents have (name, author_id; nulls ignored): pairs that the map
    lacks are added, names of ids that no document has are dropped, and a name that has several ids keeps the smallest.
    Without any observed id the map stays as it is."""
    seen = observed.where("name IS NOT NULL AND author_id IS NOT NULL").select("name", "author_id").distinct()
    if seen.limit(1).count() == 0:
        return mapping.select("name", "leader", "author_id")
    kept = mapping.select("name", "author_id").join(seen.select("author_id").distinct(), "author_id", "left_semi").select("name", "author_id")
    pairs = kept.unionByName(seen).groupBy("name").agg(F.min("author_id").alias("author_id"))
    leaders = pairs.groupBy("author_id").agg(F.min("name").alias("leader"))
    return pairs.join(leaders, "author_id").select("name", "leader", "author_id")


def save_map(mapping: DataFrame, path: str) -> None:
    mapping.select("name", "leader", "author_id").write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """A saved map; ValueError where columns are missing or a name stands there twice."""
    mapping = spark.read.parquet(path)
    if not {"name", "leader", "author_id"} <= set(mapping.columns):
        raise ValueError(f"{path} is no author map")
    if mapping.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{path} has a name twice")
    return mapping.select("name", "leader", "author_id")


def assign_author_ids(papers: DataFrame, mapping: DataFrame, doc: str = "paper_id", names: str = "author_names", most: int = 20) -> DataFrame:
    """(doc, author_ids): ids of a document's names in their order; names that cannot be matched are left out, documents
    with more than ``most`` names get an empty list."""
    rows = papers.where(F.size(names) <= most).select(doc, F.posexplode(names).alias("pos", "raw")).withColumn("name", standard_name("raw"))
    ids = rows.join(mapping.select("name", "author_id"), "name").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "author_id"))).alias("a"))
    return papers.select(doc).join(ids, doc, "left").select(doc, F.coalesce(F.col("a.author_id"), F.array().cast("array<bigint>")).alias("author_ids"))


def id_names(papers: DataFrame, doc: str = "paper_id", ids: str = "author_ids", names: str = "author_names") -> DataFrame:
    """(author_id, papers, names): documents of each id and its distinct names, names[i] belonging to ids[i]. An id without a
    name at its place (a shorter list, a null) counts for documents but gives no name."""
    rows = papers.select(doc, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(names).alias("n"))).alias("a")).where("a.i IS NOT NULL")
    return rows.groupBy(F.col("a.i").alias("author_id")).agg(F.count_distinct(doc).alias("papers"), F.count_distinct("a.n").alias("names"))


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """One row: names, authors, mean and largest number of names of an author."""
    per = mapping.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("names"), F.count(F.lit(1)).alias("authors"), F.avg("n").alias("mean_names"), F.max("n").alias("most_names"))
