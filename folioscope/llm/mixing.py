"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source; its leaves are (domain, language, source). A source's target share is
spread over its languages in proportion to its tokens there, weights add up towards the root, and budgets are
handed down from it: at each node the budget is shared by weight, a child that cannot take its part (all its
documents ``max_repeats`` times) is filled up, and what it leaves goes to its siblings; only what a whole
subtree cannot take is left to the subtree's siblings, one level up.

Within a leaf the documents run through seeded epochs: each epoch has an order of its own, whole epochs are
taken while the budget lasts, and the last one is cut where its running token count reaches the rest. The
running count never sorts a leaf in one task: tokens are first summed per hash range, and only the range in
which the budget ends is ordered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpointed

#: Hash ranges of a leaf are made so that each holds about this many documents, within these bounds.
ROWS_PER_RANGE, MIN_RANGE_BITS, MAX_RANGE_BITS = 50_000, 6, 16
#: Sources, and leaves (sources by languages), are handled on the driver up to this number.
MAX_LEAVES = 100_000


@dataclass
class Leaf:
    domain: str
    lang: str
    source: str
    weight: float
    tokens: int
    docs: int
    repeats: int
    budget: float = 0.0

    @property
    def capacity(self) -> int:
        return self.tokens * self.repeats


def share_out(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Parts of ``budget`` by weight, none above its capacity; what one cannot take goes to the others.
    Children of weight 0 take part only when all others are full."""
    parts = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    rest = min(budget, sum(capacities))
    while open_ and rest > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if parts[i] + rest * weights[i] / total >= capacities[i]]
        if not full:
            for i in open_:
                parts[i] += rest * weights[i] / total
            return parts
        for i in full:
            parts[i] = capacities[i]
        # start again among the others with all that the full ones do not hold
        rest = min(budget, sum(capacities)) - sum(parts[i] for i in range(len(parts)) if i not in open_ or i in full)
        open_ = [i for i in open_ if i not in full]
        for i in open_:
            parts[i] = 0.0
    for i in range(len(parts)):
        if rest > 1e-9 and weights[i] <= 0:
            parts[i] = min(rest, capacities[i])
            rest -= parts[i]
    return parts


def set_budgets(leaves: list[Leaf], total: float, levels: tuple[str, ...] = ("domain", "lang", "source")) -> None:
    """Hands ``total`` down the tree and stores each leaf's budget."""
    if not levels:
        for leaf in leaves:  # one leaf per path
            leaf.budget = min(total, leaf.capacity)
        return
    groups: dict[str, list[Leaf]] = {}
    for leaf in sorted(leaves, key=lambda x: getattr(x, levels[0])):
        groups.setdefault(getattr(leaf, levels[0]), []).append(leaf)
    parts = share_out(
        total, [sum(x.weight for x in g) for g in groups.values()], [sum(x.capacity for x in g) for g in groups.values()]
    )
    for part, group in zip(parts, groups.values()):
        set_budgets(group, part, levels[1:])


def sized_documents(documents: DataFrame, doc_id: str, source: str, lang: str, n_tokens: str, targets: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of the documents of listed sources that have tokens; written once."""
    language = F.lower(F.trim(F.coalesce(F.col(lang), F.lit(""))))
    rows = documents.where(F.col(source).isNotNull() & (F.col(n_tokens) > 0)).select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.when(language == "", "und").otherwise(language).alias("lang"), F.col(n_tokens).alias("n_tokens"),
    )
    return checkpointed(rows.join(targets.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "lang", "n_tokens"))


#: Asks for the largest mixture in which every source with documents has at least its target share.
REACHABLE = "reachable"


def reachable_total(leaves: list[Leaf]) -> int:
    """The largest total at which no source with documents falls short of its share: the smallest ratio of what a source
    can give, repeats included, to its share. 0 without such a source."""
    capacity: dict[str, float] = {}
    share: dict[str, float] = {}
    for x in leaves:
        if x.tokens:
            capacity[x.source] = capacity.get(x.source, 0.0) + x.capacity
            share[x.source] = share.get(x.source, 0.0) + x.weight
    return int(min((capacity[s] / w for s, w in share.items() if w > 0), default=0))


def plan(sized: DataFrame, targets: DataFrame, total: int | str | None, domains: dict[str, str]) -> list[Leaf]:
    """The leaves with their budgets. ``total``: tokens of the mixture; None takes what the listed sources hold, REACHABLE
    see ``reachable_total``."""
    rows = targets.where(F.col("source").isNotNull()).limit(MAX_LEAVES + 1).collect()
    found = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d")).limit(MAX_LEAVES + 1).collect()
    if max(len(rows), len(found)) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} sources or leaves")
    per_source: dict[str, list] = {}
    for r in found:
        per_source.setdefault(r["source"], []).append(r)
    leaves = []
    for r in rows:
        source, share = r["source"], r["target_share"] or 0.0
        repeats = max(1, r["max_repeats"] if r["max_repeats"] is not None else 1)
        own = per_source.get(source, [])
        tokens = sum(x["t"] for x in own)
        domain = domains.get(source, source)
        leaves += [Leaf(domain, x["lang"], source, share * x["t"] / tokens, x["t"], x["d"], repeats) for x in own]
        if not own:
            leaves.append(Leaf(domain, "und", source, share, 0, 0, repeats))
    if total == REACHABLE:
        total = reachable_total(leaves)
    set_budgets(leaves, total if total is not None else sum(x.tokens for x in leaves))
    return leaves


def select(sized: DataFrame, leaves: list[Leaf], seed: int) -> DataFrame:
    """(doc_id, source, epoch, n_tokens): one row for each use of a document; epochs count from 1."""
    spark = sized.sparkSession
    rows = []
    for x in leaves:
        if x.tokens and x.budget > 0:
            whole = min(int(x.budget // x.tokens), x.repeats)
            rest = int(round(x.budget - whole * x.tokens)) if whole < x.repeats else 0
            rows.append((x.source, x.lang, whole, rest))
    leaf = spark.createDataFrame(rows, "source string, lang string, whole int, rest bigint")
    most = max((x.docs for x in leaves), default=0)
    bits = min(MAX_RANGE_BITS, max(MIN_RANGE_BITS, (most // ROWS_PER_RANGE).bit_length()))
    # at most MAX_LEAVES short rows
    docs = sized.join(F.broadcast(leaf), ["source", "lang"])
    docs = docs.withColumn("__h", F.xxhash64("doc_id", F.lit(seed), F.col("whole")))
    docs = docs.withColumn("__range", F.shiftright("__h", 64 - bits))
    ranges = docs.where(F.col("rest") > 0).groupBy("source", "lang", "rest", "__range").agg(F.sum("n_tokens").alias("t"))
    order = Window.partitionBy("source", "lang").orderBy("__range")
    ranges = ranges.withColumn("upto", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the range in which the rest ends: everything before it is taken whole
    ends = ranges.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("t") < F.col("rest"))).select(
        "source", "lang", F.col("__range").alias("end"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")
    )
    docs = docs.join(F.broadcast(ends), ["source", "lang"], "left")
    before = docs.where((F.col("rest") > 0) & (F.col("__range") < F.coalesce("end", F.lit(1 << 62))))
    inner = Window.partitionBy("source", "lang").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = docs.where(F.col("__range") == F.col("end")).withColumn("__sum", F.sum("n_tokens").over(inner))
    cut = cut.where(F.col("__sum") - F.col("n_tokens") / 2 <= F.col("left"))  # the last one where at least half of it fits
    full = docs.where(F.col("whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    out = ["doc_id", "source", "epoch", "n_tokens"]
    last = (F.col("whole") + 1).alias("epoch")
    parts = [x.select("doc_id", "source", last, "n_tokens") for x in (before, cut)]
    return full.select(*out).unionByName(parts[0]).unionByName(parts[1])


def mix_sources(
    documents: DataFrame, targets: DataFrame, n_tokens: str = "n_tokens", doc_id: str = "doc_id", source: str = "source",
    lang: str = "lang", total: int | str | None = None, seed: int = 42, domains: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) for documents with a token count.

    ``targets``: source, target_share, max_repeats (null counts as 1), one row per source. Documents without a
    listed source and documents without tokens are not used; a listed source without documents leaves its share
    its siblings. No document is used more than max_repeats times. ``domains``: the domain of a source; one that is not
    named is a domain of its own. The report has one row per target: source, target_share, max_repeats,
    available_tokens, budget_tokens, used_tokens, actual_share, used_docs, off_target (actual less target share), distance
    (half the sum of all absolute off_target, 0 if the targets are met) and reachable_tokens (see ``reachable_total``).
    """
    sized = sized_documents(documents, doc_id, source, lang, n_tokens, targets)
    leaves = plan(sized, targets, total, domains or {})
    mixture = select(sized, leaves, seed)
    spark = documents.sparkSession
    per: dict[str, list[float]] = {}
    for x in leaves:
        got = per.setdefault(x.source, [0, 0.0])
        got[0] += x.tokens
        got[1] += x.budget
    budgets = spark.createDataFrame([(s, a, int(round(b))) for s, (a, b) in per.items()], "source string, available_tokens bigint, budget_tokens bigint")
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("used_docs"))
    report = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats")
    report = report.join(F.broadcast(budgets), "source").join(used, "source", "left")
    everything = Window.partitionBy()  # one row per target
    filled = report.fillna(0, ["used_tokens", "used_docs"])
    share = F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(everything), F.lit(1))
    filled = filled.withColumn("actual_share", share).withColumn("off_target", F.col("actual_share") - F.coalesce("target_share", F.lit(0.0)))
    filled = filled.withColumn("distance", F.sum(F.abs("off_target")).over(everything) / 2)
    return mixture, filled.withColumn("reachable_tokens", F.lit(reachable_total(leaves)).cast("bigint"))
