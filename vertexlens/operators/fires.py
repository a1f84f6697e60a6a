"""Forest fire sampling: many fires burn at once, a round for all of their fronts.

What burns, how far it spreads and where the next fires start is drawn by hash of vertex ids, so a burn depends on
the seed alone. A round is joins over the front: its neighbours, without what has burnt, of each vertex the few of least
draw. Nothing walks a fire vertex by vertex, and no task holds a fire, a hub's neighbours or the burnt set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlens.functions.rng import geometric, uniform
from vertexlens.graph import Graph, neighbor_sets
from vertexlens.lineage import cut_and_observe, cut_lineage
from vertexlens.operators.ranking import HUB_ROWS, least_rows, rank_within


@dataclass(frozen=True)
class FireParams:
    """A burning vertex sets light to a geometric number of its neighbours, p / (1 - p) in the mean.

    forward is p over out-edges, backward p over in-edges (0: none). As all fires are out, new ones start at
    `sparks` of the vertices wanted, one at least.
    """

    forward: float = 0.5
    backward: float = 0.0
    sparks: float = 0.05


#: Rounds after which the burnt vertices are written as one table again.
_JOINED = 16


@dataclass(frozen=True)
class _Way:
    """pairs(id, other), distinct and without loops; a vertex spreads over them with probability p. crowded: one has many of them."""

    pairs: DataFrame
    p: float
    name: str
    crowded: bool


def _ways(g: Graph, p: FireParams) -> list[_Way]:
    found = []
    for direction, share in (("out", p.forward), ("in", p.backward)):
        if share > 0:
            pairs = cut_lineage(neighbor_sets(g.edges, direction).where("id <> other"))
            most = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            found.append(_Way(pairs, share, direction, (most or 0) > HUB_ROWS))
    return found


def _spread(way: _Way, front: DataFrame, burnt: DataFrame, seed: int) -> DataFrame:
    """(id, fire) of what front(id, fire) sets light to: of each one's unburnt neighbours the few of least draw."""
    lit = front.withColumn("fan", geometric(uniform(seed, "id", F.lit(way.name + "fan")), 1 - way.p) - 1).where("fan > 0")
    open_ = lit.join(way.pairs, "id").join(burnt.select(F.col("id").alias("other")), "other", "left_anti").withColumn("u", uniform(seed, "id", "other", F.lit(way.name)))
    if way.crowded:
        ranked = rank_within(open_, "id", F.col("u"), "u", "other")
    else:
        ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("u", "other")))
    return ranked.where("rank <= fan").select(F.col("other").alias("id"), "fire")


def forest_fire(g: Graph, fraction: float, seed: int = 42, p: FireParams = FireParams()) -> DataFrame:
    """(id, round, fire): exactly floor(fraction * |V|) burnt vertices, the round in which each was lit and the vertex its fire started at.

    Each round every vertex lit in the last one draws its fan-out and lights that many of its distinct unburnt neighbours,
    those of least draw, fewer if it has fewer; one lit by several belongs to the fire of least id. Is nothing lit,
    fires start at the unburnt vertices of least draw. The last round is cut to the vertices of least draw that are still wanted.
    """
    if not (0 <= p.forward < 1 and 0 <= p.backward < 1):
        raise ValueError("forward and backward are probabilities below 1")
    ways = _ways(g, p)
    vertices, seen = cut_and_observe(g.vertices.select("id").withColumn("spark", uniform(seed, "id", F.lit("spark"))), n=F.count(F.lit(1)))
    wanted = int(fraction * seen["n"])
    sparks = max(1, int(p.sparks * wanted))
    burnt = vertices.where("false").select("id", F.lit(0).alias("round"), F.col("id").alias("fire"))
    parts: list[DataFrame] = []
    front, size, n, i = burnt, 0, 0, 0
    while n < wanted:
        size = size if ways else 0
        if size:
            lit = reduce(DataFrame.unionByName, (_spread(way, front, burnt, seed) for way in ways))
            front, seen = cut_and_observe(lit.groupBy("id").agg(F.min("fire").alias("fire")), n=F.count(F.lit(1)))
            size = seen["n"]
        if not size:
            size = min(sparks, wanted - n)
            cold = vertices.join(burnt, "id", "left_anti")
            front = cut_lineage(least_rows(cold, "spark", size, "id").select("id", F.col("id").alias("fire")))
        if size > wanted - n:
            size = wanted - n
            front = cut_lineage(least_rows(front.withColumn("u", uniform(seed, "id", F.lit("last"))), "u", size, "id").select("id", "fire"))
        parts.append(front.select("id", F.lit(i).alias("round"), "fire"))
        n, i = n + size, i + 1
        burnt = reduce(DataFrame.unionByName, parts)
        if len(parts) == _JOINED:
            parts = [burnt := cut_lineage(burnt)]
    return burnt


def forest_fire_sample(g: Graph, fraction: float, seed: int = 42, p: FireParams = FireParams()) -> Graph:
    """The burnt vertices with the edges between them."""
    chosen = forest_fire(g, fraction, seed, p).select("id")
    return g.induced(g.vertices.join(chosen, "id", "left_semi"))
