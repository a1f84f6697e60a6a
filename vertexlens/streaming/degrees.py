"""Degrees maintained over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexlens.graph import Direction, degrees


def edge_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of edges (src, dst, ts) as they arrive."""
    return spark.readStream.schema("src bigint, dst bigint, ts timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_degrees(edges: DataFrame, direction: Direction = "either") -> DataFrame:
    """(id, degree) so far; write it in update mode. State is a row per vertex."""
    return degrees(edges, direction)


def windowed_degrees(edges: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, id, degree) per tumbling window of ts; edges later than the watermark are left out and state is dropped behind it."""
    sides = edges.withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    counted = sides.groupBy(F.window("ts", every), "id").agg(F.count(F.lit(1)).alias("degree"))
    return counted.select(F.col("window.start").alias("start"), "id", "degree")


def start(rows: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
