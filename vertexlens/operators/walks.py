"""Random walks from every vertex at once, and Monte-Carlo personalised PageRank.

Walks are rows (source, ..., path); every step moves all of them by one join with the adjacency, in which neighbours
are numbered, so a step reads one row per walk and no neighbour list is ever collected. Draws are hashes of
(seed, source, segment, step). A vertex without neighbours ends its walks early.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlens.functions.rng import geometric_value, uniform, uniform_value
from vertexlens.graph import Direction, Graph, ends
from vertexlens.lineage import cut_lineage
from vertexlens.operators.ranking import rank_within


def numbered_neighbors(edges: DataFrame, direction: Direction = "either") -> DataFrame:
    """(id, place, other, n, n_other): the neighbours of each vertex with multiplicity, numbered from 0 in ascending order.

    n is how many there are, n_other how many the neighbour has (null for none), so that a walker knows it on arrival.
    """
    rows = rank_within(ends(edges, direction), "id", None, "other").select("id", (F.col("rank") - 1).alias("place"), "other", "n")
    return rows.join(sizes(edges, direction).select(F.col("id").alias("other"), F.col("n").alias("n_other")), "other", "left")


def sizes(edges: DataFrame, direction: Direction) -> DataFrame:
    return ends(edges, direction).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def moved(walks: DataFrame, steps: DataFrame, u: Column, moves: Column) -> DataFrame:
    """walks(last, n, ...) with `other`: the neighbour of place floor(u * n) where `moves` holds and there is one, else null.

    last and n are those after the move. The join is on vertex and place, so walkers that meet at a hub part again.
    """
    drawn = walks.withColumn("place", F.when(moves, F.floor(u * F.col("n")).cast("bigint")))
    to = steps.select(F.col("id").alias("last"), "place", "other", "n_other")
    picked = drawn.join(to, ["last", "place"], "left")
    kept = [c for c in walks.columns if c not in ("last", "n")]
    return picked.select(*kept, F.coalesce("other", "last").alias("last"), F.when(F.col("other").isNull(), F.col("n")).otherwise(F.col("n_other")).alias("n"), "other")


def step(walks: DataFrame, steps: DataFrame, u: Column, moves: Column) -> DataFrame:
    """Moves the walks(last, n, path, ...) for which `moves` holds, and appends where they come to."""
    rows = moved(walks, steps, u, moves)
    path = F.when(F.col("other").isNull(), F.col("path")).otherwise(F.concat("path", F.array("other")))
    return rows.withColumn("path", path).select(*walks.columns)


def walk_segments(g: Graph, length: int, theta: int, seed: int = 42, cut_every: int = 4) -> DataFrame:
    """(source, seg, path, last): ceil(length / theta) segments per vertex, of theta steps each, the last of the rest.

    path has the steps taken, without the source.
    """
    eta = -(-length // theta)
    rest = length - theta * (length // theta) or theta
    steps = cut_lineage(numbered_neighbors(g.edges))
    starts = g.vertices.select("id").join(sizes(g.edges, "either"), "id", "left")
    rows = starts.select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(eta))).alias("seg"), F.array().cast("array<bigint>").alias("path"), F.col("id").alias("last"), "n")
    for j in range(1, theta + 1):
        moves = (F.col("seg") < eta) | F.lit(j <= rest)
        rows = step(rows, steps, uniform(seed, "source", "seg", j), moves)
        if j % cut_every == 0 and j < theta:
            rows = cut_lineage(rows)
    return rows.select("source", "seg", "path", "last")


def sqrt_walk(g: Graph, length: int, theta: int, seed: int = 42, segments: DataFrame | None = None) -> DataFrame:
    """(source, path): from each source, segment i of the current tail appended for i = 1, 2, ...: length + 1 vertices."""
    eta = -(-length // theta)
    segments = cut_lineage(segments if segments is not None else walk_segments(g, length, theta, seed))
    walks = g.vertices.select(F.col("id").alias("source"), F.array("id").alias("path"), F.col("id").alias("tail"))
    for i in range(1, eta + 1):
        part = segments.where(F.col("seg") == i).select(F.col("source").alias("tail"), F.col("path").alias("more"), F.col("last").alias("next"))
        walks = walks.join(part, "tail").select("source", F.concat("path", "more").alias("path"), F.col("next").alias("tail"))
    return walks.select("source", "path")


def doubling_walk(g: Graph, length: int, theta: int, seed: int = 42, segments: DataFrame | None = None) -> DataFrame:
    """(source, path): walks of length + 1 vertices, the segments joined pairwise in ceil(log2 eta) rounds.

    In each round segment i of a vertex takes segment eta - i + 1 of its own tail; an odd middle one is carried over.
    Every segment index is used once per walk.
    """
    eta = -(-length // theta)
    rows = cut_lineage(segments if segments is not None else walk_segments(g, length, theta, seed))
    while eta > 1:
        half = (eta + 1) // 2
        joined = _combined(rows, eta)
        if eta % 2:
            joined = joined.unionByName(_copied(rows, half))
        rows, eta = cut_lineage(joined), half
    return rows.where("seg = 1").select("source", F.concat(F.array("source"), "path").alias("path"))


def _copied(rows: DataFrame, middle: int) -> DataFrame:
    return rows.where(F.col("seg") == middle)


def _combined(rows: DataFrame, eta: int) -> DataFrame:
    head = rows.where(F.col("seg") <= eta // 2).withColumn("pair", F.lit(eta + 1) - F.col("seg"))
    tail = rows.select(F.col("source").alias("last"), F.col("seg").alias("pair"), F.col("path").alias("more"), F.col("last").alias("next"))
    return head.join(tail, ["last", "pair"]).select("source", "seg", F.concat("path", "more").alias("path"), F.col("next").alias("last"))


def visit_counts(walks: DataFrame) -> DataFrame:
    """(source, target, n) of walks(source, path), the start included."""
    return walks.select("source", F.explode("path").alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def walk_lengths(count: int, alpha: float, seed: int) -> list[int]:
    return [geometric_value(uniform_value(seed, "len", r), alpha) for r in range(count)]


def ppr_monte_carlo(g: Graph, budget: int, alpha: float, seed: int = 42, per_source_length: bool = False) -> DataFrame:
    """(source, target, score) from max(1, floor(alpha * budget)) walks per source; all walks of all rounds advance together.

    A round's length is geometric and shared by all sources, or drawn per source if per_source_length. Scores are visits,
    the start included, over the sum of lengths, so a source's scores add up to (sum + walks) / sum. A walk is its place;
    visits are counted step by step, and walks that are over are not carried on.
    """
    rounds = max(1, int(alpha * budget))
    lengths = walk_lengths(rounds, alpha, seed)
    steps = cut_lineage(numbered_neighbors(g.edges, "out"))
    table = g.vertices.sparkSession.createDataFrame(list(enumerate(lengths)), "round int, steps int")
    rows = g.vertices.select(F.col("id").alias("source")).join(F.broadcast(table))
    most = max(lengths)
    if per_source_length:
        from vertexlens.functions.rng import geometric

        rows = cut_lineage(rows.withColumn("steps", geometric(uniform(seed, F.lit("len"), "source", "round"), alpha).cast("int")))
        most = rows.agg(F.max("steps")).first()[0] or 0
    total = rows.groupBy("source").agg(F.sum("steps").alias("total"))
    visits = [rows.select("source", F.col("source").alias("target"))]
    walks = rows.join(sizes(g.edges, "out").withColumnRenamed("id", "source"), "source", "left").select("source", "round", "steps", F.col("source").alias("last"), "n")
    for j in range(1, most + 1):
        on = moved(walks.where(F.col("steps") >= j), steps, uniform(seed, "source", "round", j), F.lit(True))
        walks = cut_lineage(on.where("other is not null").drop("other"))
        visits.append(walks.select("source", F.col("last").alias("target")))
    counts = functools.reduce(DataFrame.unionByName, (v.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")) for v in visits))
    counts = counts.groupBy("source", "target").agg(F.sum("n").alias("n"))
    return counts.join(total, "source").select("source", "target", (F.col("n") / F.col("total")).alias("score"))
