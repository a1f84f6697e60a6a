"""Stored graphs: vertices and edges as bucketed, sorted tables, so that joins by source move no edge and look-ups read few row groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.graph import Graph
from vertexlens.lineage import cut_and_observe

#: Bytes of a row group, which is the least that a scan reads or leaves out; pages within it are left out by their own index.
ROW_GROUP_BYTES = 16 << 20
#: Ids that are looked up by a filter; more are looked up by a join.
FILTERED_IDS = 10_000
#: Ranges of ids that such a filter tells the scan.
RANGES = 32


@dataclass(frozen=True)
class StoredGraph:
    """Two tables of the catalog, both in `buckets` buckets: vertices(id, attr) by id, edges(src, dst, attr) by src in order of (src, dst)."""

    spark: SparkSession
    name: str
    buckets: int

    @property
    def vertices(self) -> DataFrame:
        return self.spark.table(f"{self.name}_vertices")

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(f"{self.name}_edges")

    @property
    def graph(self) -> Graph:
        return Graph(self.vertices, self.edges)

    def edges_of(self, ids: DataFrame) -> DataFrame:
        """The out-edges of the vertices of ids(id); null and repeated ids are harmless.

        Up to FILTERED_IDS ids become a filter: their buckets are the only files that are opened, and of those the row
        groups within RANGES ranges of ids, cut at the widest gaps. More ids are joined, bucket by bucket, without an
        exchange or a sort of the edges.
        """
        wanted, seen = cut_and_observe(ids.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct(), n=F.count(F.lit(1)))
        if seen["n"] <= FILTERED_IDS:
            return self.edges.where(_among("src", sorted(r["id"] for r in wanted.collect())))
        dealt = wanted.select(F.col("id").alias("src")).repartition(self.buckets, "src")
        return self.edges.join(dealt.hint("shuffle_hash"), "src", "left_semi")

    def drop(self) -> None:
        for kind in ("vertices", "edges"):
            self.spark.sql(f"drop table if exists {self.name}_{kind}")


def _among(column: str, ids: list[int]) -> Column:
    """column is one of the ascending ids, and so in one of few ranges, which row groups can be told apart by."""
    if not ids:
        return F.lit(False)
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    near = F.lit(False)
    for a, z in zip(cuts, cuts[1:]):
        near = near | F.col(column).between(ids[a], ids[z - 1])
    return F.col(column).isin(ids) & near


def store_graph(g: Graph, name: str | None = None, buckets: int | None = None) -> StoredGraph:
    """Writes g as tables `name`_vertices and `name`_edges in the warehouse, one sorted file a bucket; an existing graph of that name is replaced."""
    spark = g.edges.sparkSession
    stored = StoredGraph(spark, name or f"graph_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored.drop()
    for rows, kind, key, order in ((g.vertices, "vertices", "id", ["id"]), (g.edges, "edges", "src", ["src", "dst"])):
        dealt = rows.repartition(stored.buckets, key).sortWithinPartitions(*order)
        writer = dealt.write.format("parquet").option("parquet.block.size", ROW_GROUP_BYTES).bucketBy(stored.buckets, key).sortBy(*order)
        writer.saveAsTable(f"{stored.name}_{kind}")
    return stored


@contextmanager
def stored(g: Graph, buckets: int | None = None) -> Iterator[StoredGraph]:
    """g as a stored graph for as long as the context lasts."""
    kept = store_graph(g, buckets=buckets)
    try:
        yield kept
    finally:
        kept.drop()
