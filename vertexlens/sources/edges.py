"""Reading and writing graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.graph import Graph


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """edges(src, dst, attr=1) of a text file: two whitespace-separated ids a line, blank and # lines skipped, more tokens ignored.

    canonical orients every edge from the smaller to the larger id; repeats stay repeated.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    t = lines.select(F.split("v", r"\s+").alias("t")).select(F.col("t")[0].cast("bigint").alias("src"), F.col("t")[1].cast("bigint").alias("dst"))
    return canonical_edges(t) if canonical else t.withColumn("attr", F.lit(1))


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1).alias("attr"))


def read_delimited_edges(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(edges, signatures): a delimited edge file and (id, in_degree) counted, as its source did, by the first column."""
    edges = spark.read.csv(path, sep=sep, schema="src bigint, dst bigint", comment="#").where("src is not null").withColumn("attr", F.lit(1))
    return edges, edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def from_rows(spark: SparkSession, edges: list[tuple[int, int]], vertices: list[int] | None = None) -> Graph:
    """A graph from driver-side rows."""
    g = Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    if vertices is None:
        return g
    return Graph(spark.createDataFrame([(v, 1) for v in vertices], "id bigint, attr int"), g.edges)


def write_graph(g: Graph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def append_csv(rows: DataFrame, path: str) -> None:
    """Appends a few result rows, without a header."""
    rows.coalesce(1).write.mode("append").csv(path)
