import random

import pytest
from pyspark.sql import functions as F

from vertexlens.graph import degrees
from vertexlens.operators.sampling import node_sample, repeat, repeat_stored
from vertexlens.plans.experiment import run_experiment
from vertexlens.sources import adjacency
from vertexlens.sources.adjacency import store_graph, stored
from vertexlens.sources.edges import from_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def g(spark):
    r = random.Random(1)
    return from_rows(spark, [(r.randrange(500), r.randrange(500)) for _ in range(4000)] + [(7, i) for i in range(300)] * 2, list(range(520)))


def rows(df):
    return sorted(map(tuple, df.select("src", "dst").collect()))


@pytest.mark.parametrize("most", [10_000, 2])
def test_lookups_of_many_vertices(spark, g, monkeypatch, most):
    monkeypatch.setattr(adjacency, "FILTERED_IDS", most)
    ids = spark.createDataFrame([(7,), (7,), (100,), (None,), (519,), (-5,), (499,)], "id bigint")
    with stored(g, 5) as kept:
        found = kept.edges_of(ids)
        assert rows(found) == sorted((a, b) for a, b in rows(g.edges) if a in (7, 100, 519, 499))
        assert rows(kept.edges_of(ids.where("false"))) == []
        if most == 2:
            part = plan(found).split("FileScan")[0]
            assert part.count("Exchange") == 0 and "Bucketed: true" in plan(found) and "Sort " not in plan(found).split("FileScan")[0]
        else:
            assert "In(src" in plan(found) and "Exchange" not in plan(found)


def test_a_lookup_opens_one_bucket_and_few_row_groups(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "ROW_GROUP_BYTES", 4096)
    big = from_rows(spark, [(i, j) for i in range(3000) for j in range(20)])
    kept = store_graph(big, "wide", 3)
    try:
        found = kept.edges_of(spark.createDataFrame([(1500,), (1501,)], "id bigint"))
        assert found.count() == 40
        scan = found._jdf.queryExecution().executedPlan()
        found.collect()
        while scan.children().size():
            scan = scan.children().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        assert 40 <= read < 0.3 * 60_000
    finally:
        kept.drop()
    assert not spark.catalog.tableExists("wide_edges")


def test_degrees_and_samples_move_no_edge_by_source(spark, g):
    with stored(g, 4) as kept:
        assert "Exchange" not in plan(degrees(kept.edges, "out"))
        assert sorted(map(tuple, degrees(kept.edges, "out").collect())) == sorted(map(tuple, degrees(g.edges, "out").collect()))
        near = spark.range(0, 500, 3).select(F.col("id").alias("src")).hint("shuffle_hash")
        assert plan(kept.edges.join(near, "src")).split("FileScan")[0].count("Exchange") == 0


def test_repeated_samples_of_a_stored_graph(spark, g):
    found, plain = repeat_stored(node_sample, g, 0.4, 3, 5), repeat(node_sample, g, 0.4, 3, 5)
    assert [rows(s.edges) for s in found] == [rows(s.edges) for s in plain]
    assert [sorted(r.id for r in s.vertices.collect()) for s in found] == [sorted(r.id for r in s.vertices.collect()) for s in plain]


@pytest.mark.parametrize("kind", ["forest fire", "weighted layered"])
def test_the_experiment_knows_the_new_samplers(spark, g, kind):
    row = run_experiment(g, kind, 0.3, "connectedComponents", n=2).first()
    assert row.sampleType == kind and 0 <= row.metricScore <= 1 and row.sampleTime > 0
