"""The experiment: sample a graph, query the sample and the whole, and write how far apart the answers are.

    python -m vertexlens.plans.experiment EDGES SAMPLER FRACTION QUERY N STITCHING OUTPUT
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.graph import Graph, degrees
from vertexlens.lineage import cut_lineage
from vertexlens.operators import metrics
from vertexlens.operators.clustering import triangles
from vertexlens.operators.components import connected_components
from vertexlens.operators.fires import forest_fire_sample
from vertexlens.operators.ranks import pagerank
from vertexlens.operators.sampling import SampleKind, layered_sample, repeat_stored, sampler, weighted_layered_sample
from vertexlens.operators.split import split_by_degree
from vertexlens.operators.walkers import as_graph, random_jump_sample, random_walk_sample
from vertexlens.sources.edges import append_csv, read_edge_list

#: query name -> answer over a graph, as (id, score) or (id, component)
QUERIES: dict[str, Callable[[Graph], DataFrame]] = {
    "pageRank": lambda g: pagerank(g, 10),
    "triangleCount": lambda g: triangles(g).select("id", F.col("triangles").cast("double").alias("score")),
    "connectedComponents": connected_components,
}

RESULT_SCHEMA = (
    "sampleType string, sampleFrac double, queryAlgo string, metricName string, metricScore double, "
    "numSamples int, stitchStrategy string, sampleTime double, computeTime double, totalTime double"
)


def stitch(results: list[DataFrame], strategy: str) -> DataFrame:
    """`first` takes the first sample's answer, `mean` averages scores per vertex over the samples that have it."""
    if strategy == "first":
        return results[0]
    if strategy == "mean" and "score" in results[0].columns:
        rows = results[0]
        for r in results[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("id").agg(F.avg("score").alias("score"))
    raise ValueError(f"stitching {strategy!r}: 'first', or 'mean' for scores")


def evaluate(query: str, truth: DataFrame, found: DataFrame) -> DataFrame:
    """(metricName, metricScore) of a query's answers."""
    if query == "pageRank":
        a = metrics.topk_edit_distance(truth, found).select(F.lit("edit distance").alias("metricName"), F.col("edit_distance").cast("double").alias("metricScore"))
        b = metrics.topk_intersection(truth, found).select(F.lit("intersection").alias("metricName"), F.col("intersection").cast("double").alias("metricScore"))
        return a.unionByName(b)
    if query == "connectedComponents":
        return metrics.components_fraction_wrong(truth, found).select(F.lit("fraction wrong").alias("metricName"), F.col("fraction_wrong").alias("metricScore"))
    if query == "triangleCount":
        return metrics.mean_abs_error(truth, found).select(F.lit("mean absolute error").alias("metricName"), F.col("error").alias("metricScore"))
    raise ValueError(f"query {query!r}: one of {', '.join(QUERIES)}")


def _samplers(g: Graph) -> dict[str, Callable[[Graph, float, int], Graph]]:
    def layered(g: Graph, fraction: float, seed: int) -> Graph:
        sparse, dense = split_by_degree(degrees(g.edges))
        return layered_sample(g, fraction, sparse, dense, seed)

    return {
        SampleKind.LAYERED.value: layered,
        SampleKind.WEIGHTED_LAYERED.value: weighted_layered_sample,
        SampleKind.FOREST_FIRE.value: forest_fire_sample,
        SampleKind.RANDOM_WALK.value: lambda g, f, seed: as_graph(random_walk_sample(g, f, seed=seed)),
        SampleKind.RANDOM_JUMP.value: lambda g, f, seed: as_graph(random_jump_sample(g, f, seed=seed)),
    }


def answers(g: Graph, kind: str, fraction: float, query: str, n: int, stitching: str, seed: int) -> tuple[DataFrame, DataFrame, float, float, float]:
    """(truth, found, seconds to sample, to query, in all); each step is materialised, so a time holds its own work only."""
    if query not in QUERIES:
        raise ValueError(f"query {query!r}: one of {', '.join(QUERIES)}")
    t0 = time.perf_counter()
    draw = sampler(kind, _samplers(g))
    samples = repeat_stored(draw, g, fraction, n, seed) if n > 1 else [Graph(cut_lineage(s.vertices), cut_lineage(s.edges)) for s in [draw(g, fraction, seed)]]
    t1 = time.perf_counter()
    found = cut_lineage(stitch([QUERIES[query](s) for s in samples], stitching))
    t2 = time.perf_counter()
    return QUERIES[query](g), found, t1 - t0, t2 - t1, t2 - t0


def run_experiment(g: Graph, kind: str, fraction: float, query: str = "pageRank", n: int = 1, stitching: str = "first", seed: int = 42) -> DataFrame:
    """Result rows of RESULT_SCHEMA."""
    truth, found, sample_s, query_s, total_s = answers(g, kind, fraction, query, n, stitching, seed)
    rows = evaluate(query, truth, found)
    return rows.select(
        F.lit(kind).alias("sampleType"), F.lit(float(fraction)).alias("sampleFrac"), F.lit(query).alias("queryAlgo"), "metricName", "metricScore",
        F.lit(n).alias("numSamples"), F.lit(stitching).alias("stitchStrategy"), F.lit(sample_s).alias("sampleTime"), F.lit(query_s).alias("computeTime"), F.lit(total_s).alias("totalTime"),
    )


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path", help="edge list: two ids a line")
    p.add_argument("sample_type", help=", ".join(k.value for k in SampleKind))
    p.add_argument("fraction", type=float)
    p.add_argument("query", choices=sorted(QUERIES))
    p.add_argument("samples", type=int)
    p.add_argument("stitching", choices=["first", "mean"])
    p.add_argument("output", help="folder that result rows are appended to as CSV")
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"{a.query} on {a.sample_type} {a.fraction}").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    g = Graph.from_edges(read_edge_list(spark, a.path, canonical=a.query == "triangleCount"))
    append_csv(run_experiment(g, a.sample_type, a.fraction, a.query, a.samples, a.stitching, a.seed), a.output)


if __name__ == "__main__":
    main()
