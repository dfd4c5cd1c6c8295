"""The document schema and its column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import iso_date


@dataclass(frozen=True)
class Field:
    name: str
    dtype: T.DataType
    extract: Callable[[DataFrame], Column]


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _string(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if _has(df, name) else F.lit("")


def author_list(df: DataFrame, name: str = "authors") -> Column:
    """Flat upper-case names from any of the usual shapes: pairs [last, first] (written "FIRST, LAST"), structs with
    a field ``name``, a list of names, one string with ";" between names. Missing or null gives null."""
    if not _has(df, name):
        return F.lit(None).cast("array<string>")
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        return F.transform(name, lambda a: F.upper(F.trim(F.concat_ws(", ", F.get(a, F.lit(1)), F.get(a, F.lit(0))))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(name, lambda a: F.upper(F.trim(a["name"])))
    if isinstance(kind, T.ArrayType):
        return F.transform(name, lambda a: F.upper(F.trim(a)))
    parts = F.transform(F.split(F.col(name).cast("string"), ";"), lambda a: F.upper(F.trim(a)))
    return F.filter(parts, lambda a: a != "")


def category_list(df: DataFrame, name: str = "categories") -> Column:
    """A list as it is, a string split at blanks, else an empty list."""
    empty = F.array().cast("array<string>")
    if not _has(df, name):
        return empty
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), empty)
    return F.coalesce(F.filter(F.split(F.trim(name), "\\s+"), lambda c: c != ""), empty)


FIELDS = [
    Field("title", T.StringType(), _string("title")),
    Field("date", T.DateType(), lambda df: iso_date(F.col("date").cast("string")) if _has(df, "date") else F.lit(None).cast("date")),
    Field("raw_text", T.StringType(), _string("raw_text")),
    Field("author_names", T.ArrayType(T.StringType()), author_list),
    Field("author_ids", T.ArrayType(T.LongType()), lambda df: F.lit(None).cast("array<bigint>")),
    Field("preprocessed_text", T.ArrayType(T.StringType()), lambda df: F.lit(None).cast("array<string>")),
    Field("categories", T.ArrayType(T.StringType()), category_list),
]
COLUMNS = [f.name for f in FIELDS]


def rename_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by {source: target}; a source overwrites a column of the target's name."""
    mapping = {a: b for a, b in mapping.items() if a in df.columns and a != b}
    return df.drop(*[b for b in mapping.values() if b in df.columns]).withColumnsRenamed(mapping)


def to_schema(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The seven document columns (and ``keep``) of raw entries; a date that is written but can't be read drops the
    entry, as a bad entry is skipped; a missing date stays null."""
    out = df.select(*(keep or []), *[f.extract(df).alias(f.name) for f in FIELDS], (F.col("date").cast("string") if _has(df, "date") else F.lit(None)).alias("__date"))
    bad = F.col("date").isNull() & (F.trim(F.coalesce("__date", F.lit(""))) != "")
    return out.where(~bad).drop("__date")


def is_valid() -> Column:
    """Title, date, text and author names are there; empty strings and lists pass."""
    return F.col("title").isNotNull() & F.col("date").isNotNull() & F.col("raw_text").isNotNull() & F.col("author_names").isNotNull()


def load_summary(df: DataFrame) -> DataFrame:
    """One row: valid and invalid rows, first and last date."""
    return df.agg(
        F.count_if(is_valid()).alias("valid_rows"), F.count_if(~is_valid()).alias("invalid_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
