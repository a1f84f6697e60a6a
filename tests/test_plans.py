import pytest

import __spark_entry__ as entry
from vertexlens.operators import metrics
from vertexlens.plans.experiment import evaluate, main, run_experiment, stitch
from vertexlens.sources.edges import from_rows
from vertexlens.streaming.degrees import edge_stream, start, streaming_degrees, windowed_degrees

EDGES = [(a, (a * k + k) % 30) for a in range(30) for k in range(1, 7)]


@pytest.fixture(scope="module")
def g(spark):
    return from_rows(spark, EDGES)


def test_entry_points(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


@pytest.mark.parametrize("kind, query", [("edge", "pageRank"), ("layered", "connectedComponents"), ("node", "triangleCount"), ("random walk", "pageRank")])
def test_experiment(g, kind, query):
    rows = run_experiment(g, kind, 0.3, query).collect()
    assert len(rows) == (2 if query == "pageRank" else 1)
    assert all(r.totalTime >= r.sampleTime >= 0 and r.sampleType == kind for r in rows)


def test_no_sampling_is_exact(g):
    got = {r.metricName: r.metricScore for r in run_experiment(g, "no sampling", 1.0, n=2, stitching="mean").collect()}
    assert got == {"edit distance": 0.0, "intersection": 30.0}


def test_bad_arguments(g, spark):
    with pytest.raises(ValueError):
        run_experiment(g, "guided", 0.3)
    with pytest.raises(ValueError):
        run_experiment(g, "edge", 0.3, "shortestPaths")
    with pytest.raises(ValueError):
        stitch([spark.createDataFrame([(1, 1)], "id bigint, component bigint")], "mean")
    with pytest.raises(ValueError):
        evaluate("x", None, None)


def test_command_line(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text("\n".join(f"{a} {b}" for a, b in EDGES))
    out = str(tmp_path / "out")
    for _ in range(2):
        main([str(f), "edge", "0.4", "pageRank", "1", "first", out])
    assert spark.read.csv(out).count() == 4


def test_metrics(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(10)], "id bigint, score double")
    b = spark.createDataFrame([(i, float(9 - i)) for i in range(5)] + [(50, 1.0)], "id bigint, score double")
    assert metrics.topk_intersection(a, b, 3).first()[0] == 0
    assert metrics.topk_edit_distance(a, a, 5).first()[0] == 0
    assert abs(metrics.mean_abs_error(a, b).first()[0] - sum(abs(9 - 2 * i) for i in range(5)) / 6) < 1e-9
    c = spark.createDataFrame([(1, 1), (2, 1)], "id bigint, component bigint")
    d = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id bigint, component bigint")
    assert abs(metrics.components_fraction_wrong(c, d).first()[0] - 2 / 3) < 1e-9
    s = spark.createDataFrame([(1.0, 2.0)], "degree double, value double")
    t = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "degree double, value double")
    assert metrics.norm_mean(s, t).first()[0] == 2.5 and metrics.norm_max(s, t).first()[0] == 4.0


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    src = str(tmp_path / "in")
    spark.createDataFrame(EDGES, "src bigint, dst bigint").withColumn("ts", F.timestamp_seconds(F.col("src") * 600)).write.parquet(src)
    q = start(streaming_degrees(edge_stream(spark, src)), "deg", "update")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(degree) from (select id, max(degree) as degree from deg group by id)").first()[0] == 2 * len(EDGES)
    q = start(windowed_degrees(edge_stream(spark, src)), "win", "append")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(distinct start) from win").first()[0] >= 3
