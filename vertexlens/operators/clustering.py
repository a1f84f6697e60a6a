"""Triangles, clustering coefficients and degree statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlens.graph import Direction, Graph, degrees, neighbor_sets
from vertexlens.operators.triangles import corner_counts, triangles


def global_clustering(g: Graph) -> DataFrame:
    """(id, cc): 2 triangles / (d (d - 1)) with the multigraph degree d, 0 where d < 2."""
    d = degrees(g.edges, "either")
    joined = triangles(g).join(d, "id", "left")
    pairs = F.col("degree") * (F.col("degree") - 1)
    return joined.select("id", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / pairs).otherwise(0.0).alias("cc"))


def _sets(g: Graph, direction: Direction, chosen: DataFrame | None) -> DataFrame:
    rows = neighbor_sets(g.edges, direction)
    return rows if chosen is None else rows.join(chosen.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")


def local_clustering(g: Graph, direction: Direction = "either", chosen: DataFrame | None = None) -> DataFrame:
    """(id, degree, cc) of every vertex (of chosen(id), if given, with neighbours in it only).

    degree is the size of the neighbour set. `either`: ordered linked pairs / (d (d - 1)); `in`, `out`: distinct
    unordered linked pairs / (d (d - 1) / 2), a pair being linked if one is in the other's set. Self-loops count, so a
    coefficient can exceed 1; d < 2 gives 0.

    Linked pairs of other vertices are triangles, counted at those corners that have both others in their set. A neighbour with a loop is
    linked with itself; a vertex with a loop is its own neighbour, linked with all of its neighbours.
    """
    edges = g.edges if chosen is None else Graph(chosen, g.edges).inside(chosen)
    rows = neighbor_sets(edges, direction)
    d = rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    sides = 2 if direction == "either" else 1
    linked = corner_counts(edges, direction).select("id", (sides * F.col("triangles")).alias("linked"))
    loops = edges.where("src = dst").select(F.col("src").alias("other")).distinct()
    looped = rows.join(loops, "other").groupBy("id").agg(F.count_if(F.col("id") != F.col("other")).alias("looped"), F.bool_or(F.col("id") == F.col("other")).alias("own"))
    every = (g.vertices if chosen is None else chosen).select("id")
    joined = every.join(d, "id", "left").join(linked, "id", "left").join(looped, "id", "left").na.fill(0, ["degree", "linked", "looped"])
    own = F.when(F.col("own"), sides * F.col("degree") - (sides - 1)).otherwise(0)
    pairs = F.col("degree") * (F.col("degree") - 1) / (3 - sides)
    return joined.select("id", "degree", F.when(F.col("degree") > 1, (F.col("linked") + F.col("looped") + own) / pairs).otherwise(0.0).alias("cc"))


def clustering_by_degree(local: DataFrame) -> DataFrame:
    """(degree, value): mean coefficient per degree."""
    return local.groupBy(F.col("degree").cast("double").alias("degree")).agg(F.avg("cc").alias("value"))


def set_degrees(g: Graph, direction: Direction = "either", chosen: DataFrame | None = None) -> DataFrame:
    """(id, degree) by neighbour sets, 0 included."""
    d = _sets(g, direction, chosen).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return (g.vertices if chosen is None else chosen).select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_cumavg(d: DataFrame) -> DataFrame:
    """(degree, value) of (id, degree): vertices up to the j-th distinct degree, divided by j. Works on the histogram."""
    h = d.groupBy(F.col("degree").cast("double").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("degree")
    return h.select("degree", (F.sum("n").over(up) / F.row_number().over(up)).alias("value"))


def degree_cdf(d: DataFrame) -> DataFrame:
    """(degree, value): the share of vertices of at most that degree."""
    h = d.groupBy(F.col("degree").cast("double").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("degree", (F.sum("n").over(Window.orderBy("degree")) / F.sum("n").over(Window.partitionBy())).alias("value"))
