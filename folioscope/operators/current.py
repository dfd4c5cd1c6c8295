"""The current row of each key: the one with the latest time stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed


def current_rows(df: DataFrame, key: str, ts: str, columns: dict[str, Column] | list[str]) -> DataFrame:
    """Latest row per ``key`` by ``ts``, reduced to ``key`` and ``columns`` before the one shuffle.

    Exact repeats collapse to one row. A null time stamp loses against any other; rows that tie are
    compared by ``columns``, so the result does not depend on the order of arrival. Rows with a null
    key are dropped. An empty table gives an empty result; columns that are not asked for are never read.
    """
    cols = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    packed = F.struct(F.col(ts).alias("__ts"), *[c.alias(f"__{i}") for i, c in enumerate(cols.values())])
    latest = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), packed.alias("__row"))
    latest = latest.groupBy("__key").agg(F.max("__row").alias("__row"))
    return latest.select(
        F.col("__key").alias(key), *[F.col(f"__row.__{i}").alias(name) for i, name in enumerate(cols)]
    )


#: Keys with several rows that are broadcast (two numbers each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 200_000


def current_wide_rows(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """As ``current_rows``, for wide columns of which few keys have several rows: only keys and time stamps are shuffled to
    find those keys, and only their rows move. Reads the key and the time stamp once more."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.col(ts).alias("__ts"), *columns)
    several = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key, F.lit(True).alias("__several")))
    if several.count() <= BROADCAST_KEYS:
        several = F.broadcast(several)
    marked = rows.join(several, key, "left")
    single = marked.where("__several IS NULL").select(key, *columns)
    return single.unionByName(current_rows(marked.where("__several"), key, "__ts", columns))
