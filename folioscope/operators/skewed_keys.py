"""Per-key results where a few keys hold most records.

Every step is an algebraic aggregate, so each partition first combines its own rows in a bounded hash table
(which spills mergeable states) and only one compact state per key and partition is shuffled. A key that
stands in a third of all rows therefore costs a reducer no more than any other key. Distinct co-values are
exact: distinct (key, co-value) pairs are formed first, spread by the pair, then counted per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed


def _exploded(df: DataFrame, record: str, fields: list[str], extra: list[str]) -> DataFrame:
    """(field, item_key, record, extra...): each non-null key once per record."""
    arrays = F.array(*[
        F.struct(F.lit(f).alias("field"), F.array_distinct(F.array_compact(F.col(f).cast("array<string>"))).alias("keys"))
        for f in fields
    ])
    keep = list(dict.fromkeys([record, *extra]))
    return df.select(*keep, F.explode(arrays).alias("__f")).select(
        F.col("__f.field").alias("field"), F.explode("__f.keys").alias("item_key"), *keep
    )


def key_counts(df: DataFrame, record: str, fields: list[str], date: str) -> DataFrame:
    """(field, item_key, papers, first_date, last_date) for every non-null key of the array columns ``fields``.

    ``df`` holds one row per record. Null and empty arrays and null elements give no rows; a key counts once
    per record; null dates are ignored.
    """
    rows = _exploded(df, record, fields, [date])
    return rows.groupBy("field", "item_key").agg(
        F.count(F.lit(1)).alias("papers"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def key_results(df: DataFrame, record: str, fields: list[str], date: str, other: str) -> DataFrame:
    """``key_counts`` with ``coauthors``: the distinct values of the array column ``other`` that occur in the
    key's records, the key itself not counted where ``field`` is ``other``. ``df`` is written once and read by both parts."""
    df = checkpointed(df.select(*dict.fromkeys([record, *fields, date, other])))
    rows = _exploded(df.withColumn("__other", F.array_distinct(F.array_compact(F.col(other).cast("array<string>")))), record, fields, ["__other"])
    pairs = (
        rows.select("field", "item_key", F.explode("__other").alias("__o"))
        .where((F.col("field") != other) | (F.col("item_key") != F.col("__o")))
        .distinct()
    )
    others = pairs.groupBy("field", "item_key").agg(F.count(F.lit(1)).alias("coauthors"))
    counts = key_counts(df, record, fields, date)
    return counts.join(others, ["field", "item_key"], "left").withColumn(
        "coauthors", F.coalesce(F.col("coauthors"), F.lit(0)).cast("bigint")
    )


def heavy_keys(df: DataFrame, record: str, fields: list[str], date: str, share: float, least: int) -> DataFrame:
    """(field, item_key): keys in at least ``share`` of all records and in at least ``least`` records."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    # one row: the number of records
    counted = key_counts(df, record, fields, date).join(F.broadcast(total))
    return counted.where((F.col("papers") >= least) & (F.col("papers") >= share * F.col("__n"))).select("field", "item_key")
