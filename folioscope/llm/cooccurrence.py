"""Items that appear together: counts of unordered pairs and how far they exceed chance.

Method: every pair is packed into one 64-bit code. A map task fills a buffer with codes, sorts it and writes
it as a sorted run of (code, count), so equal pairs are combined before anything is shuffled. The shuffle by
code with a sort inside each partition is an external merge sort (it spills sorted runs and merges them);
a run-length pass over the merged order then adds the counts up. Odds ratios get a continuity correction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

#: Codes held in memory by one map task before they are sorted and written as a run (8 bytes each).
RUN_CODES = 1 << 22
_HALF = 31


def _pairs(values: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Packed codes of all pairs within each list, in pieces of about RUN_CODES; values ascend in each list."""
    ends = np.cumsum(lengths)
    later = np.repeat(ends, lengths) - np.arange(len(values)) - 1  # partners that follow each element
    total = np.cumsum(later)
    start = 0
    while start < len(values):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + RUN_CODES, "right")))
        n = later[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield (values[left] << _HALF) | values[right]
        start = stop


def _run(codes: np.ndarray) -> pa.RecordBatch:
    codes, counts = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])


def _write_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        column = batch.column(0)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(column.offsets.to_numpy())
        for codes in _pairs(values, lengths):
            held.append(codes)
            size += len(codes)
            if size >= RUN_CODES:
                yield _run(np.concatenate(held))
                held, size = [], 0
    if size:
        yield _run(np.concatenate(held))


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length addition over codes in ascending order; the last code of a batch is carried on."""
    code, count = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        codes = np.concatenate([code, batch.column(0).to_numpy(zero_copy_only=False)])
        counts = np.concatenate([count, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(codes):
            continue
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums = np.add.reduceat(counts, first)
        codes = codes[first]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(sums[:-1])], ["code", "n"])
        code, count = codes[-1:], sums[-1:]
    if len(code):
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])


def _dense(items: DataFrame) -> DataFrame:
    """(item, code) with codes 0, 1, ... in the order of the items, numbered per partition plus an offset;
    only one count per partition reaches the driver."""
    ordered = checkpointed(
        items.select("item").distinct().sort("item").select("item", F.monotonically_increasing_id().alias("__m"))
    )
    part = F.shiftright("__m", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    if sum(sizes.values()) >= 1 << _HALF:
        raise ValueError(f"more than 2**{_HALF} distinct items cannot be packed in pairs")
    offsets, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(F.lit(at).cast("bigint"))
        at += sizes.get(p, 0)
    known = F.array(*offsets) if offsets else F.array(F.lit(0).cast("bigint"))
    return ordered.select("item", (F.get(known, part.cast("int")) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("code"))


def pair_counts(records: DataFrame, items: str, min_count: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio) of every pair in at least ``min_count`` records.

    ``records`` has one row per record and the items in the array column ``items`` (BIGINT). Null arrays and
    null elements are ignored, an item counts once per record, and ``n`` counts the records with at least one
    item; item_a < item_b. Any BIGINT works: ids within a range of 2**31 are packed by their distance from the
    smallest, others through dense numbers. lift = n_ab * n / (n_a * n_b); the odds ratio adds 0.5 to each cell.
    A record of any length is streamed in pieces. An empty table gives an empty result.
    """
    lists = records.select(F.array_sort(F.array_distinct(F.array_compact(F.col(items).cast("array<bigint>")))).alias("ids"))
    lists = checkpointed(lists.where(F.size("ids") > 0))
    n, low, high = lists.agg(
        F.count(F.lit(1)), F.min(F.element_at("ids", 1)), F.max(F.element_at("ids", -1))
    ).first()
    single = lists.select(F.explode("ids").alias("item"))
    counts = single.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    # each pair stands there once, so even an item of all records brings no more rows to a join than there are items
    low = low or 0
    if (high or 0) - low < 1 << _HALF:
        packed = lists.where(F.size("ids") > 1).select(F.transform("ids", lambda x: x - F.lit(low)).alias("ids"))
        names = None
    else:
        names = checkpointed(_dense(single))
        spread = lists.where(F.size("ids") > 1).select(F.monotonically_increasing_id().alias("__r"), "ids")
        spread = checkpointed(spread).select("__r", F.explode("ids").alias("item")).join(names, "item")
        packed = spread.groupBy("__r").agg(F.array_sort(F.collect_list("code")).alias("ids")).select("ids")
    runs = packed.mapInArrow(_write_runs, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code bigint, n bigint")
    pairs = merged.where(F.col("n") >= min_count).select(
        F.shiftright("code", _HALF).alias("a"), F.col("code").bitwiseAND(F.lit((1 << _HALF) - 1)).alias("b"), F.col("n").alias("n_ab")
    )
    if names is None:
        pairs = pairs.select((F.col("a") + low).alias("item_a"), (F.col("b") + low).alias("item_b"), "n_ab")
    else:
        for side in "ab":
            pairs = pairs.join(names.select(F.col("code").alias(side), F.col("item").alias(f"item_{side}")), side)
    for side in "ab":
        pairs = pairs.join(counts.select(F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}")), f"item_{side}")
    pairs = pairs.withColumn("n", F.lit(n).cast("bigint"))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift().alias("lift"), odds_ratio().alias("odds_ratio"))


def lift() -> Column:
    return F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))


def odds_ratio() -> Column:
    """Odds ratio of the 2x2 table with 0.5 added to each cell."""
    both, half = F.col("n_ab"), F.lit(0.5)
    neither = F.col("n") - F.col("n_a") - F.col("n_b") + both
    return ((both + half) * (neither + half)) / ((F.col("n_a") - both + half) * (F.col("n_b") - both + half))
