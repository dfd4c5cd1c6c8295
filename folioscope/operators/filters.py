"""Row filters of document tables; all are plain predicates, so they merge and reach the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import any_date


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Both ends inclusive, either may be missing; a table without the column passes through."""
    if column not in df.columns:
        return df
    for bound, compare in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            day = df.sparkSession.range(1).select(any_date(F.lit(bound))).first()[0]
            if day is None:
                raise ValueError(f"not a date: {bound!r}")
            df = df.where(compare(F.col(column), F.lit(day)))
    return df


def any_category(df: DataFrame, wanted: list[str], column: str = "categories") -> DataFrame:
    """Rows with at least one of ``wanted``; string cells are split at commas and blanks; null is no match."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        c = F.split(F.translate(c, ",", " "), " +")
    return df.where(F.coalesce(F.exists(c, lambda x: x.isin(wanted)), F.lit(False)))


def year_and_authors(df: DataFrame, first: int | None = None, last: int | None = None, authors: list[int] | None = None) -> DataFrame:
    """Years ``first`` to ``last`` and, if given, at least one of ``authors``."""
    if first is not None:
        df = df.where(F.year("date") >= first)
    if last is not None:
        df = df.where(F.year("date") <= last)
    return df if authors is None else df.where(F.exists("author_ids", lambda a: a.isin(authors)))


def non_empty(df: DataFrame, column: str = "preprocessed_text") -> DataFrame:
    return df.where(F.size(column) > 0)


FILTERS: dict[str, Callable[..., DataFrame]] = {
    "date_range": lambda df, c: date_range(df, c.get("start"), c.get("end")),
    "categories": lambda df, c: any_category(df, c["include"] if isinstance(c, dict) else c, c.get("column", "categories") if isinstance(c, dict) else "categories"),
    "custom": lambda df, f: df.where(f(df)),
}


def filter_counts(df: DataFrame, filters: dict) -> DataFrame:
    """(step, filter, rows): rows before any filter (step 0) and after each one, in their order. One aggregate per step."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(0).alias("step"), F.lit(None).cast("string").alias("filter"), "rows")
    for step, name in enumerate(filters, 1):
        df = apply_filters(df, {name: filters[name]})
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(step).alias("step"), F.lit(name).alias("filter"), "rows"))
    return rows


def apply_filters(df: DataFrame, config: dict) -> DataFrame:
    """Filters in the order of ``config``: date_range {start, end}, categories [..] or {include, column}, custom
    (DataFrame -> boolean Column); ValueError for another name."""
    for name, value in config.items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}")
        df = FILTERS[name](df, value)
    return df
