"""Streaming forms of the engine's aggregates: event-time windows, sessions, incremental co-author edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, name: str, like: T.StructType) -> DataFrame:
    """A stream over the parquet files of ``folder`` that match ``name``."""
    return spark.readStream.schema(like).option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by..., n, total): counts and sums per tumbling event-time window; rows later than ``late`` are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = stamped.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(key, start, n): events per session, a session ending after ``gap`` without one."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works off all that is there now, exactly once, into a parquet folder; returns what the folder holds."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def incremental_edges(papers: DataFrame, path: str, checkpoint: str, authors: str = "author_ids") -> DataFrame:
    """Co-author counts per micro-batch, one folder per batch so that a batch that runs again replaces itself; the sum over
    the folders is the graph. Each paper must come once."""
    from folioscope.operators.graph import coauthor_edges

    def write(batch: DataFrame, number: int) -> None:
        coauthor_edges(batch, authors).write.mode("overwrite").parquet(f"{path}/batch={number}")

    papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return papers.sparkSession.read.parquet(path).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
