"""Connected components by contraction, with every round's edges in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlens.graph import Graph
from vertexlens.lineage import cut_lineage


def component_map(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges(a bigint, b bigint).

    Each round every node points to its smallest neighbour (or itself) and the graph is contracted along the
    pointers; an edge set at least halves its nodes per round, so the number of rounds is logarithmic. Loops and
    repeated edges are harmless; no edges give no rows. Minima are pre-aggregated, so a hub costs one row a task.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e"))
        step = cut_lineage(ends.groupBy(F.col("e.id").alias("id")).agg(F.min("e.to").alias("to")))
        maps.append(step)
        moved = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = cut_lineage(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = maps[-1].select("id", F.col("to").alias("component"))
    for step in reversed(maps[:-1]):
        later = found.select(F.col("id").alias("to"), "component")
        found = step.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return found


def connected_components(g: Graph) -> DataFrame:
    """(id, component) of every vertex, isolated ones included: weakly connected, labelled by the smallest id."""
    found = component_map(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_count(components: DataFrame) -> DataFrame:
    return components.agg(F.countDistinct("component").alias("n_components"))
