"""Sources by file extension: readers that turn files into raw entries, and the fixed path from there."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import schema
from folioscope.operators.filters import apply_filters
from folioscope.session import find_package

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}


def _dotted(extension: str) -> str:
    extension = extension.lower()
    return extension if extension.startswith(".") else f".{extension}"


def register_reader(*extensions: str) -> Callable[[Reader], Reader]:
    """Decorator; ValueError where another reader has the extension."""

    def add(reader: Reader) -> Reader:
        for e in map(_dotted, extensions):
            if _READERS.get(e, reader) is not reader:
                raise ValueError(f"{e} already has a reader")
            _READERS[e] = reader
        return reader

    return add


def reader_for(extension: str) -> Reader | None:
    return _READERS.get(_dotted(extension))


def supported_extensions() -> set[str]:
    return set(_READERS)


def common_reader(extensions: list[str]) -> Reader | None:
    """The one reader of all the extensions; None if there are none or several."""
    readers = {reader_for(e) for e in extensions}
    return readers.pop() if len(readers) == 1 else None


def compatible(extensions: list[str]) -> bool:
    return common_reader(extensions) is not None


def clear_registry() -> None:
    _READERS.clear()


ENTRY = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("date", T.StringType()), T.StructField("raw_text", T.StringType()),
    T.StructField("authors", T.StringType()), T.StructField("categories", T.StringType()),
])


@register_reader("json", "jsonl")
def read_json(spark: SparkSession, paths: list[str], entry: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """JSON lines. With ``entry`` nothing is inferred; a line that cannot be read is dropped, or stops the job if ``strict``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(entry) if entry else reader).json(paths)


@register_reader("parquet")
def read_parquet(spark: SparkSession, paths: list[str], **_: object) -> DataFrame:
    return spark.read.parquet(*paths)


@register_reader("csv", "tsv")
def read_csv(spark: SparkSession, paths: list[str], entry: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """With a header; all columns are strings unless ``entry`` says otherwise."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", True)
    reader = reader.option("sep", "\t" if paths and paths[0].endswith(".tsv") else ",")
    return (reader.schema(entry) if entry else reader).csv(paths)


@register_reader("orc")
def read_orc(spark: SparkSession, paths: list[str], **_: object) -> DataFrame:
    return spark.read.orc(paths)


@register_reader("txt", "text")
def read_text(spark: SparkSession, paths: list[str], **_: object) -> DataFrame:
    """One entry per file: its name as title, its text as raw_text."""
    return spark.read.option("wholetext", True).text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("title"), F.col("value").alias("raw_text"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of the edges of a GraphML file with numeric ids, lower id first."""
    tags = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"<edge\b[^>]*>"), F.lit(0))).alias("tag"))
    end = lambda name: F.regexp_extract("tag", rf"\b{name}=[\"']\D*(\d+)[\"']", 1)
    ends = tags.select(F.try_to_number(end("source"), F.lit("9" * 19)).cast("bigint").alias("a"), F.try_to_number(end("target"), F.lit("9" * 19)).cast("bigint").alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder of any file system that the cluster knows; empty if there is no such folder."""
    files, where = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files of a folder that a reader is registered for."""
    return [f"{folder}/{n}" for n in list_files(spark, folder) if PurePosixPath(n).suffix in _READERS]


def load(
    spark: SparkSession, paths: str | list[str], mapping: dict[str, str] | None = None, filters: dict | None = None,
    entry: T.StructType | None = None, strict: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """Documents in the fixed schema with ``is_valid``: read, rename, project, filter. Lazy, so filters reach the scan. All
    paths must have extensions of one reader; any path that the cluster's file systems know will do."""
    find_package(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = common_reader([PurePosixPath(p).suffix for p in paths]) if paths else None
    if reader is None:
        raise ValueError(f"no common reader for {paths}; supported: {sorted(_READERS)}")
    raw = reader(spark, paths, entry=entry, strict=strict)
    docs = schema.to_schema(schema.rename_fields(raw, mapping or {}), keep)
    return apply_filters(docs, filters or {}).withColumn("is_valid", schema.is_valid())


def valid(docs: DataFrame, by_date: bool = False) -> DataFrame:
    """Valid documents, in the order of their dates if asked for (one range shuffle of whole rows)."""
    out = docs.where("is_valid").drop("is_valid")
    return out.sort("date") if by_date else out


def invalid(docs: DataFrame, by_date: bool = False) -> DataFrame:
    out = docs.where("NOT is_valid").drop("is_valid")
    return out.sort("date") if by_date else out
