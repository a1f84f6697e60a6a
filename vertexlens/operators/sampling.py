"""Graph samplers. All draws are hash-derived (functions.rng), so a sample depends on the seed alone.

A sample's edges are cached on first use, as its vertices and every query on it read them.
"""

from __future__ import annotations

import enum
import math
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform
from vertexlens.functions.scalars import dice, round_half_up
from vertexlens.graph import Graph, degrees, neighbor_sets
from vertexlens.lineage import cut_lineage
from vertexlens.operators.ranking import least_within, occurrences, rank_within, smallest
from vertexlens.sources.adjacency import stored


class SampleKind(enum.Enum):
    NODE = "node"
    EDGE = "edge"
    EDGE_BY_VERTEX = "edge by vertex"
    RANDOM_JUMP = "random jump"
    RANDOM_WALK = "random walk"
    FOREST_FIRE = "forest fire"
    LAYERED = "layered"
    WEIGHTED_LAYERED = "weighted layered"
    GUIDED = "guided"
    NONE = "no sampling"


class Sampler(Protocol):
    def __call__(self, g: Graph, fraction: float, seed: int) -> Graph: ...


def node_sample(g: Graph, fraction: float, seed: int = 42) -> Graph:
    """Each vertex with probability `fraction`, isolated ones included; the induced edges."""
    return g.induced(g.vertices.where(uniform(seed, "id") < fraction))


def edge_sample(g: Graph, fraction: float, seed: int = 42) -> Graph:
    """Each edge row with probability `fraction`, parallel ones independently; vertices are the endpoints."""
    rows = occurrences(g.edges).where(uniform(seed, "src", "dst", "occ") < fraction)
    return Graph.from_edges(rows.select("src", "dst", "attr").persist())


def edge_by_vertex_sample(g: Graph, fraction: float, seed: int = 42) -> Graph:
    """Of each vertex's out-edges exactly round-half-up(fraction * out-degree), uniformly; vertices without any vanish."""
    rows = occurrences(g.edges).withColumn("u", uniform(seed, "src", "dst", "occ"))
    ranked = rank_within(rows, "src", F.col("u"), "u", "dst", "occ")
    kept = ranked.where(F.col("rank") <= round_half_up(F.col("n") * fraction))
    return Graph.from_edges(kept.select("src", "dst", F.lit(1).alias("attr")).persist())


def reservoir_sample(items: DataFrame, key: str, item: str, fraction: float, seed: int = 42) -> DataFrame:
    """(key, item): per key a uniform round-half-up(fraction * n)-subset of its rows, 0 <= fraction <= 1; items distinct per key."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction {fraction} is not in [0, 1]")
    ranked = rank_within(items.select(key, item).withColumn("u", uniform(seed, key, item)), key, F.col("u"), "u", item)
    return ranked.where(F.col("rank") <= round_half_up(F.col("n") * fraction)).select(key, item)


def random_elements(items: DataFrame, key: str, item: str, seed: int = 42) -> DataFrame:
    """(key, picked): per key one of its rows, that of place floor(u * n) in order of item, repeats included; no list is collected."""
    ranked = rank_within(items.select(key, item), key, None, item)
    return ranked.where(F.col("rank") - 1 == F.floor(uniform(seed, key) * F.col("n"))).select(key, F.col(item).alias("picked"))


def random_subsets(items: DataFrame, key: str, item: str, k: int, seed: int = 42) -> DataFrame:
    """(key, item): per key k of its rows (all, if fewer), those of least draw by item and place in order of item; no list is collected."""
    placed = rank_within(items.select(key, item), key, None, item).select(key, item, uniform(seed, item, F.col("rank") - 1).alias("u"))
    return rank_within(placed, key, F.col("u"), "u", item).where(F.col("rank") <= k).select(key, item)


def uniform_subset(vertices: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly floor(fraction * |V|) vertices, uniformly."""
    return smallest(vertices.withColumn("_u", uniform(seed, "id")), "_u", fraction, "id").drop("_u")


def layered_sample(g: Graph, fraction: float, sparse: DataFrame, dense: DataFrame, seed: int = 42) -> Graph:
    """All of dense(id, degree) and each of sparse with probability `fraction`, with the induced edges; attr is the degree."""
    chosen = sparse.where(uniform(seed, "id") < fraction).unionByName(dense)
    return g.induced(chosen.select("id", F.col("degree").cast("int").alias("attr")))


def degree_layers(g: Graph) -> DataFrame:
    """(id, degree, layer, weight): layers by the degree's power of two, at most 64 of them; the weight is the degree."""
    d = degrees(g.edges)
    return d.select("id", "degree", (F.length(F.bin("degree")) - 1).alias("layer"), F.col("degree").cast("double").alias("weight"))


def weighted_subset(layers: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Of each layer of layers(id, layer, weight, ...) exactly round-half-up(fraction * n) rows, without replacement, by weight.

    Every vertex draws the key -ln(u) / weight, and a layer keeps its least ones: the first is drawn in proportion to the
    weights, the next in proportion to those of the rest, and so on. A null weight, or one that is not positive, comes after all
    others, by id. A layer's boundary is found in a histogram of keys. Layers are few: their sizes come to the driver. The keyed rows
    are written once, so what gives the layers (degrees over all edges, say) is not run again for each look at them.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction {fraction} is not in [0, 1]")
    drawn = -F.log(F.greatest(uniform(seed, "id"), F.lit(1e-300))) / F.col("weight")
    keyed = cut_lineage(layers.withColumn("_key", F.coalesce(F.when(F.col("weight") > 0, F.least(drawn, F.lit(1e300))), F.lit(1e300))))
    wanted = {r["layer"]: math.floor(fraction * r["n"] + 0.5) for r in keyed.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    return least_within(keyed, "layer", "_key", wanted, "id").drop("_key")


def weighted_layered_sample(g: Graph, fraction: float, seed: int = 42, layers: DataFrame | None = None) -> Graph:
    """weighted_subset of layers(id, layer, weight, degree), by default degree_layers, with the induced edges; attr is the degree."""
    chosen = weighted_subset(degree_layers(g) if layers is None else layers, fraction, seed)
    return g.induced(chosen.select("id", F.col("degree").cast("int").alias("attr")))


def cocitation_weights(g: Graph, q: int) -> DataFrame:
    """(id, weight): similarity of each vertex's out-neighbour set N to Q = N(q) + {q}; null where it is 0 / 0.

    Both sets stay in long form: a hub's neighbours are counted by partial aggregation, never collected.
    """
    out = neighbor_sets(g.edges, "out")
    of_q = out.where(F.col("id") == q).select("other").unionByName(g.vertices.sparkSession.range(1).select(F.lit(q).cast("bigint").alias("other"))).distinct()
    size_q = of_q.agg(F.count(F.lit(1)).alias("size_q"))
    common = out.join(of_q.withColumn("hit", F.lit(1)), "other", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("common"))
    every = g.vertices.select("id").join(common, "id", "left").na.fill(0, ["n", "common"])
    return every.join(F.broadcast(size_q)).select("id", dice(F.col("common"), F.col("n"), F.col("size_q")).alias("weight"))


def cocitation_sample(g: Graph, q: int, seed: int = 42) -> Graph:
    """All distinct out-edges of the vertices v with draw < weight(v); the fraction plays no part."""
    return Graph.from_edges(_gated(g, q, seed))


def cocitation_intersect_sample(g: Graph, q: int, seed: int = 42) -> Graph:
    """Of those vertices only the out-edges into Q."""
    out = neighbor_sets(g.edges, "out").where(F.col("id") == q).select(F.col("other").alias("dst"))
    own = g.vertices.sparkSession.range(1).select(F.lit(q).cast("bigint").alias("dst"))
    return Graph.from_edges(_gated(g, q, seed).join(out.unionByName(own).distinct(), "dst", "left_semi").select("src", "dst"))


def _gated(g: Graph, q: int, seed: int) -> DataFrame:
    open_ = cocitation_weights(g, q).where(uniform(seed, "id") < F.col("weight")).select("id")
    return neighbor_sets(g.edges, "out").join(open_, "id", "left_semi").select(F.col("id").alias("src"), F.col("other").alias("dst"))


def no_sample(g: Graph, fraction: float = 1.0, seed: int = 42) -> Graph:
    return g


#: name -> sampler; samplers that need more than (graph, fraction, seed) are registered by the experiment.
SAMPLERS: dict[str, Callable[[Graph, float, int], Graph]] = {
    SampleKind.NODE.value: node_sample,
    SampleKind.EDGE.value: edge_sample,
    SampleKind.EDGE_BY_VERTEX.value: edge_by_vertex_sample,
    SampleKind.NONE.value: no_sample,
}


def sampler(kind: str | SampleKind, extra: dict[str, Sampler] | None = None) -> Sampler:
    name = kind.value if isinstance(kind, SampleKind) else kind
    known = SAMPLERS | (extra or {})
    if name not in known:
        raise ValueError(f"no sampler {name!r}: one of {', '.join(sorted(known))}")
    return known[name]


def edge_samples(g: Graph, fraction: float, n: int, seed: int = 42) -> DataFrame:
    """(sample_id, src, dst, attr): n independent edge samples in one pass, sample i drawn with key i."""
    rows = occurrences(g.edges).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.where(uniform(seed, "sample_id", "src", "dst", "occ") < fraction).select("sample_id", "src", "dst", "attr")


def repeat(sample: Sampler, g: Graph, fraction: float, n: int, seed: int = 42) -> list[Graph]:
    """n independent samples by any sampler, with seeds seed, seed + 1, ..."""
    return [sample(g, fraction, seed + i) for i in range(n)]


def repeat_stored(sample: Sampler, g: Graph, fraction: float, n: int, seed: int = 42) -> list[Graph]:
    """As repeat, but g is stored once, bucketed by source, and the samples are drawn from there and written: no sample moves all edges by source."""
    with stored(g) as kept:
        return [Graph(cut_lineage(s.vertices), cut_lineage(s.edges)) for s in repeat(sample, kept.graph, fraction, n, seed)]
