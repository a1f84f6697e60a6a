"""Joins by the fields that messages name, active rounds, dense numbers, random elements without lists, blocked Bloom filters, stream reservoirs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vertexlens.functions import scalars
from vertexlens.functions.blocked_bloom import BlockedBloom
from vertexlens.functions.rng import uniform, uniform_value
from vertexlens.graph import Graph, aggregate_messages, triplets_with
from vertexlens.lineage import cut_and_observe, written
from vertexlens.operators import ranking
from vertexlens.operators.ranking import dense_numbers
from vertexlens.operators.ranks import distances, pagerank_active, pagerank_until
from vertexlens.operators.sampling import random_elements, random_subsets
from vertexlens.sources.edges import from_rows
from vertexlens.streaming.reservoirs import batch_reservoirs, latest, reservoirs

_R = random.Random(6)
EDGES = [(_R.randrange(40), _R.randrange(40)) for _ in range(160)] + [(2, i) for i in range(40)] + [(50, 51), (51, 52), (60, 60)]


@pytest.fixture(scope="module")
def g(spark):
    return from_rows(spark, EDGES)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("to_src", "to_dst", "joins"), [("1", "attr", 0), (None, "src_attr + attr", 1), ("dst_attr", None, 1), ("dst_attr", "src_attr", 2), ("src + dst", "src", 0)])
def test_only_named_ends_are_joined(spark, g, to_src, to_dst, joins):
    marked = g.map_vertices((F.col("id") * 3).cast("int"))
    a, b = (None if e is None else F.expr(e).cast("bigint") for e in (to_src, to_dst))
    assert plan(triplets_with(marked, [e for e in (a, b) if e is not None])).count("Join") == joins
    value = lambda e, s, d: eval(e, {"src": s, "dst": d, "attr": 1, "src_attr": 3 * s, "dst_attr": 3 * d})  # noqa: E731, S307
    want = Counter()
    for s, d in EDGES:
        if to_src:
            want[s] += value(to_src, s, d)
        if to_dst:
            want[d] += value(to_dst, s, d)
    assert {r.id: r.message for r in aggregate_messages(marked, F.sum, a, b).collect()} == dict(want)


def test_active_pagerank_is_near_the_exact_one_with_ever_fewer_senders(g):
    exact = {r.id: r.score for r in pagerank_until(g, 1e-12).collect()}
    found, senders = pagerank_active(g, 1e-9)
    assert all(abs(r.score - exact[r.id]) < 1e-6 for r in found.collect())
    half = len(senders) // 2
    assert senders[0] == len(exact) and senders[-1] < senders[0] / 4 and sum(senders[half:]) < sum(senders[:half])
    rough, fewer = pagerank_active(g, 0.01)
    assert sum(fewer) < sum(senders) / 2
    low = {r.id: r.score for r in rough.collect()}
    assert all(low[v] <= exact[v] + 1e-9 for v in exact)
    assert sum(exact[v] - low[v] for v in exact) <= 0.85 / 0.15 * 0.01 * len(exact)


def test_distances_by_rounds_of_the_newly_reached(spark, g):
    near = {}
    for a, b in EDGES:
        near.setdefault(a, set()).add(b)
    want, front, d = {2: 0, 50: 0}, {2, 50}, 0
    while front:
        d += 1
        front = {w for v in front for w in near.get(v, ()) if w not in want}
        want |= dict.fromkeys(front, d)
    found, senders = distances(g, spark.createDataFrame([(2,), (50,), (50,), (999,)], "id bigint"))
    assert {r.id: r.distance for r in found.collect()} == {v: want.get(v) for v in {x for e in EDGES for x in e}}
    assert senders == [sum(x == k for x in want.values()) for k in range(max(want.values()) + 1)]
    assert distances(g, spark.createDataFrame([], "id bigint"))[1] == []


def test_dense_numbers(spark, g):
    ids = [5, -7, 1 << 60, 0, 3] + list(range(1000, 3000, 7))
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, name string").repartition(7)
    rows = dense_numbers(df, "id")
    assert sorted((r.number, r.id) for r in rows.collect()) == list(enumerate(sorted(ids)))
    assert "Window [" not in plan(rows).replace("windowspecdefinition(_part", "") or plan(rows).count("Window") == 1
    assert dense_numbers(df.where("false"), "id").count() == 0
    pairs = dense_numbers(spark.createDataFrame([(1, 2), (1, 1), (0, 9), (1, 1)], "a int, b int"), "a", "b")
    assert sorted((r.number, r.a, r.b) for r in pairs.collect()) == [(0, 0, 9), (1, 1, 1), (2, 1, 1), (3, 1, 2)]
    again, to = g.renumbered()
    number = {r.id: r.number for r in to.collect()}
    assert number == {v: i for i, v in enumerate(sorted({x for e in EDGES for x in e}))}
    assert Counter((r.src, r.dst) for r in again.edges.collect()) == Counter((number[a], number[b]) for a, b in EDGES)
    assert sorted(r.id for r in again.vertices.collect()) == sorted(number.values())


@pytest.mark.parametrize("hub", [1_000_000, 5])
def test_random_elements_equal_those_of_lists(spark, g, monkeypatch, hub):
    monkeypatch.setattr(ranking, "HUB_ROWS", hub)
    rows = g.edges.select(F.col("src").alias("id"), "dst")
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_list("dst")).alias("l"))
    want = {r.id: r.x for r in lists.select("id", scalars.random_element(F.col("l"), uniform(4, "id")).alias("x")).collect()}
    assert {r.id: r.picked for r in random_elements(rows, "id", "dst", 4).collect()} == want
    want = Counter((r.id, r.x) for r in lists.select("id", F.explode(scalars.random_subset(F.col("l"), 3, 4)).alias("x")).collect())
    assert Counter((r.id, r.dst) for r in random_subsets(rows, "id", "dst", 3, 4).collect()) == want
    assert "collect_list" not in plan(random_elements(rows, "id", "dst", 4))


def test_blocked_bloom(spark, tmp_path):
    ids, others = spark.range(20_000), spark.range(1_000_000, 1_050_000)
    f = BlockedBloom.sized(ids, 0.01)
    assert all(r.might_contain for r in f.test(ids).collect())
    wrong = f.test(others).where("might_contain").count() / 50_000
    assert 0 < wrong < 0.03
    assert "Generate" not in plan(f.rows) and "Generate" not in plan(f.test(ids))  # a row an id, not one a bit
    assert f.rows.count() <= f.blocks and f.rows.count() > 0.9 * f.blocks
    f.save(str(tmp_path / "f"))
    more = BlockedBloom.load(spark, str(tmp_path / "f"), f.blocks).add(spark.range(5_000_000, 5_000_010))
    assert more.test(spark.range(5_000_000, 5_000_010)).where("might_contain").count() == 10
    assert more.test(spark.createDataFrame([(None,)], "id bigint")).collect() == [(None, False)]
    rows = spark.createDataFrame([(1, 2, "k"), (1, 2, "k"), (1, None, "k"), (3_000_000, 1, "k")], "a bigint, b bigint, _row string")
    assert BlockedBloom.sized(ids, 1e-6).keep(rows, "a", "b").collect() == [(1, 2, "k")] * 2
    with pytest.raises(ValueError):
        f.merge(BlockedBloom.build(ids, f.blocks + 1))
    assert BlockedBloom.sized(ids.where("false"), 0.01).test(ids.limit(5)).where("might_contain").count() == 0


def test_a_prefilter_leaves_the_edges_inside(spark, g):
    some = g.vertices.where("id % 3 = 0")
    both = [sorted((r.src, r.dst) for r in g.inside(some, prefilter=rate).collect()) for rate in (None, 0.01)]
    assert both[0] == both[1] == sorted((a, b) for a, b in EDGES if a % 3 == 0 == b % 3)


def test_a_stream_keeps_the_reservoirs_of_a_table(spark, tmp_path):
    rows = [(i % 7 if i % 3 else 0, i) for i in range(600)]
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], "id bigint, item bigint").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{part}"))
    stream = spark.readStream.schema("id bigint, item bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part*"))
    found = latest(spark, reservoirs(stream, 4, 9), "stream-test")
    assert spark.read.parquet(found.inputFiles()[0].rsplit("/trigger=", 1)[0]).select("trigger").distinct().count() == 3
    want = sorted((v, i) for v in range(7) for _, i in sorted((uniform_value(9, v, i), i) for w, i in rows if w == v)[:4])
    assert sorted((r.id, r.item) for r in found.collect()) == want
    assert sorted(map(tuple, batch_reservoirs(spark.createDataFrame(rows, "id bigint, item bigint"), 4, 9).collect())) == want


def test_observed_counts_and_tables_that_go(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "one job")
    cut, seen = cut_and_observe(df, rows=F.count(F.lit(1)), most=F.max("n"))
    spark.sparkContext.setJobGroup("later", "")
    assert (seen["rows"], seen["most"]) == (7, 15) and cut.count() == 7
    plain = len(jobs.getJobIdsForGroup("observed"))
    with written(df) as kept:
        path = kept.inputFiles()[0]
        assert kept.count() == 7
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        spark.read.parquet(path).count()
    assert plain <= 3  # what AQE makes of the one action
    assert isinstance(Graph(cut, cut), Graph)
