import math

import pytest
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform_value
from vertexlens.operators import ranking
from vertexlens.operators.ranking import least_rows, least_within
from vertexlens.operators.sampling import degree_layers, weighted_layered_sample, weighted_subset
from vertexlens.sources.edges import from_rows


def key(seed, i, w):
    return min(-math.log(max(uniform_value(seed, i), 1e-300)) / w, 1e300) if w and w > 0 else 1e300


def brute(rows, fraction, seed):
    out = []
    for layer in {r[1] for r in rows}:
        own = sorted((key(seed, i, w), i) for i, la, w in rows if la == layer)
        out += [i for _, i in own[: math.floor(fraction * len(own) + 0.5)]]
    return sorted(out)


def some_layers():
    rows = [(i, i % 4, float(1 + i % 9)) for i in range(400)]
    return rows + [(1000, 9, None), (1001, 9, 0.0), (1002, 9, -1.0), (1003, 9, 2.0), (1004, 10, 1.0)]


@pytest.mark.parametrize("edge_rows", [100_000, 5])
@pytest.mark.parametrize("fraction", [0.0, 0.13, 0.5, 1.0])
def test_exact_sizes_and_the_same_vertices_as_a_sort(spark, monkeypatch, fraction, edge_rows):
    monkeypatch.setattr(ranking, "_EDGE_ROWS", edge_rows)
    rows = some_layers()
    df = spark.createDataFrame(rows, "id bigint, layer int, weight double")
    assert sorted(r.id for r in weighted_subset(df, fraction, 5).collect()) == brute(rows, fraction, 5)


def test_shares_follow_the_weights(spark):
    """One of a layer of four is drawn: each as often as its share of the weights, over many layers."""
    n = 6000
    df = spark.range(4 * n).select("id", (F.col("id") % n).cast("int").alias("layer"), (F.floor(F.col("id") / n) + 1).cast("double").alias("weight"))
    wanted = {i: 1 for i in range(n)}
    keyed = df.withColumn("k", -F.log(F.greatest((F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("1"), "id").cast("binary")), 1, 13), 16, 10).cast("bigint") / 4503599627370496.0), F.lit(1e-300))) / F.col("weight"))
    got = {r.weight: r.n for r in least_within(keyed, "layer", "k", wanted, "id").groupBy("weight").agg(F.count(F.lit(1)).alias("n")).collect()}
    for w in (1.0, 2.0, 3.0, 4.0):
        assert abs(got[w] / n - w / 10) < 4 * math.sqrt(w / 10 * (1 - w / 10) / n)


def test_layers_by_degree_and_the_induced_sample(spark):
    edges = [(0, i) for i in range(1, 20)] + [(i, i + 1) for i in range(1, 30)] + [(5, 5)]
    g = from_rows(spark, edges)
    layers = {r.id: (r.degree, r.layer, r.weight) for r in degree_layers(g).collect()}
    assert layers[0] == (19, 4, 19.0) and layers[30] == (1, 0, 1.0) and layers[5][1] == 2
    s = weighted_layered_sample(g, 0.5, 3)
    ids = {r.id for r in s.vertices.collect()}
    assert sorted(ids) == brute([(i, la, w) for i, (_, la, w) in layers.items()], 0.5, 3)
    assert sorted((r.src, r.dst) for r in s.edges.collect()) == sorted((a, b) for a, b in edges if a in ids and b in ids)
    with pytest.raises(ValueError):
        weighted_subset(degree_layers(g), 1.5)


def test_least_rows_with_ties_and_more_than_there_are(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_EDGE_ROWS", 3)
    df = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "id bigint, u double")
    assert sorted(r.id for r in least_rows(df, "u", 37, "id").collect()) == list(range(37))
    assert least_rows(df, "u", 500, "id").count() == 100 and least_rows(df, "u", 0, "id").count() == 0
    assert least_rows(df.where("false"), "u", 5, "id").count() == 0


def test_layers_are_derived_once(spark):
    rows = some_layers()
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "id bigint, layer int, weight double").mapInArrow(passed, "id bigint, layer int, weight double")
    assert sorted(r.id for r in weighted_subset(df, 0.13, 5).collect()) == brute(rows, 0.13, 5)
    assert seen.value == len(rows)
