"""Numbers 0, 1, 2, ... in an order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

_ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: the position of each row in the total order ``order``, from ``first``. Rows are range-partitioned and
    sorted, numbered within their partition, and moved on by the rows of the partitions before; only one count per
    partition reaches the driver. Eager: the sorted rows are written to the shared checkpoint folder once."""
    placed = checkpointed(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS).cast("int")
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    offsets, at = [], first
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(F.lit(at).cast("bigint"))
        at += sizes.get(p, 0)
    start = F.get(F.array(*offsets), part) if offsets else F.lit(first).cast("bigint")
    return placed.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__at")
