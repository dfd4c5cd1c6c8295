"""Small scalar and set helpers: indices of chunk topics, keys of maps, unions of lists, names of datasets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.numbering import numbered


def chunk_topic_index(chunk: Column | str, topic: Column | str, per_chunk: int, chunks: int | None = None) -> Column:
    """chunk * per_chunk + topic; a row outside the ranges stops the job. Null in, null out."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (chunk, topic))
    inside = (c >= 0) & (t >= 0) & (t < per_chunk) & (c < chunks if chunks is not None else F.lit(True))
    return F.when(inside, (c * per_chunk + t).cast("bigint")).when(inside.isNotNull(), F.raise_error(F.lit("chunk or topic out of range")).cast("bigint"))


def split_topic_index(index: Column | str, per_chunk: int) -> tuple[Column, Column]:
    """(chunk, topic) of an index."""
    i = F.col(index) if isinstance(index, str) else index
    return F.floor(i / per_chunk).cast("bigint"), F.pmod(i, F.lit(per_chunk)).cast("bigint")


def catalan(n: int) -> int:
    """(2n)! / (n! (n + 1)!)."""
    return math.comb(2 * n, n) // (n + 1)


def first_key(m: Column | str, value: object) -> Column:
    """First key of a map with the given value, null if there is none."""
    return F.get(F.map_keys(F.map_filter(m, lambda _, v: v == value)), F.lit(0))


def nth_row(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The n-th row in an order, from 0; negative numbers count from the end. IndexError if there is no such row."""
    size = df.count()
    if not -size <= n < size:
        raise IndexError(n)
    return numbered(df, order, "__n").where(F.col("__n") == n % size).drop("__n")


def merged_values(df: DataFrame, column: str) -> DataFrame:
    """(value): every distinct non-null element of a list column over all rows."""
    return df.select(F.explode(column).alias("value")).where("value IS NOT NULL").distinct()


def common_values(a: Column | str, b: Column | str) -> Column:
    """Elements of both lists, each once, sorted."""
    return F.array_sort(F.array_intersect(a, b))


def split_lists(df: DataFrame, column: str, name: str, keep: list[str], by: str = ",") -> DataFrame:
    """(keep..., name): one row per non-empty, trimmed part of a delimited string."""
    parts = F.filter(F.transform(F.split(F.col(column), re.escape(by)), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(*keep, F.explode(parts).alias(name))


def count_unique(df: DataFrame, column: str, only: list[str] | None = None) -> DataFrame:
    """One row ``n``: distinct non-null values of a column, or elements of a list column; of ``only`` these, if given."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    rows = df.select(value.alias("value"))
    rows = rows.where(F.col("value").isin(only)) if only is not None else rows
    return rows.agg(F.count_distinct("value").alias("n"))


def check_name(name: str) -> str:
    """A dataset's name: lower-case letters, digits and underscores, no digit first; else ValueError."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError(f"bad name {name!r}")
    return name


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, high, n) of all ``bins`` equal ranges of [low, high]; the last one holds ``high``; values outside are left
    out, empty ranges count 0."""
    width = (high - low) / bins
    x = F.col(column).cast("double")
    found = df.where((x >= low) & (x <= high)).groupBy(F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, reach: float) -> DataFrame:
    """Rows of both tables with |a - b| <= reach (numbers). Values are cut into cells of the width ``reach``; each right row
    goes to its own and the two neighbouring cells, so the join is one on equal cells."""
    if reach <= 0:
        raise ValueError("reach must be positive")
    cell = lambda c: F.floor(F.col(c) / reach)
    spread = right.withColumn("__cell", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return left.withColumn("__cell", cell(a)).join(spread, "__cell").where(F.abs(F.col(a) - F.col(b)) <= reach).drop("__cell")
