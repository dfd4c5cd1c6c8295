"""Sinks: stage tables, edge lists, GraphML, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def write_table(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = True, by: list[str] | None = None) -> None:
    """``overwrite`` False leaves what is there. CSV cannot hold lists and structs, so they are written as JSON strings."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    if form == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).format(form).save(path)


def write_pairs(edges: DataFrame, path: str) -> None:
    """Each edge once, smaller end first, tab-separated."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs.write.mode("overwrite").option("sep", "\t").csv(path)


def graphml_lines(edges: DataFrame) -> DataFrame:
    """(value): GraphML elements, one line per node and edge, an edge's id made of its ends in order."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lo, hi = F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string")
    node = nodes.select(F.format_string('<node id="n%s"/>', F.col("id").cast("string")).alias("value"))
    edge = e.select(F.format_string('<edge id="%s%s" source="n%s" target="n%s"/>', lo, hi, lo, hi).alias("value"))
    return node.unionByName(edge)


def write_graphml(edges: DataFrame, path: str) -> None:
    """A folder of GraphML elements, one per line (see ``read_graph``)."""
    graphml_lines(edges).write.mode("overwrite").text(path)


def convert_graph(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """One GraphML file rewritten with sorted ends and ids made of them; whether it was written (an existing target stays
    unless ``overwrite``)."""
    from folioscope.sources.registry import exists, read_graph

    if exists(spark, target) and not overwrite:
        return False
    write_graphml(read_graph(spark, source), target)
    return True


def convert_graphs(spark: SparkSession, folder: str, prefix: str = "viz_", overwrite: bool = False) -> list[str]:
    """Every GraphML file of a folder that has not the prefix, written beside it with the prefix; the names written."""
    from folioscope.sources.registry import list_files

    names = [n for n in list_files(spark, folder) if n.endswith(".graphml") and not n.startswith(prefix)]
    return [prefix + n for n in names if convert_graph(spark, f"{folder}/{n}", f"{folder}/{prefix}{n}", overwrite)]


def graph_to_pairs(spark: SparkSession, source: str, target: str) -> None:
    """The links of a GraphML file as tab-separated pairs."""
    from folioscope.sources.registry import read_graph

    write_pairs(read_graph(spark, source), target)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
