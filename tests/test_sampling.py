import math
import random

import pytest
from pyspark.sql import functions as F

from vertexlens.functions.bloom import BloomFilter
from vertexlens.functions.rng import geometric, geometric_continue, geometric_value, uniform, uniform_value
from vertexlens.functions.scalars import edit_distance, max_pair, random_element, random_subset
from vertexlens.graph import degrees
from vertexlens.operators import ranks as rk
from vertexlens.operators import sampling as sa
from vertexlens.operators import walkers as wk
from vertexlens.operators import walks as wl
from vertexlens.operators.ranking import occurrences, rank_within, smallest
from vertexlens.operators.split import split_by_degree
from vertexlens.sources.edges import from_rows

EDGES = [(a, (a * k + k) % 40) for a in range(40) for k in range(1, 9)]


def adjacency(src, dst, direction):
    adj = {}
    for a, b in zip(src, dst):
        if direction in ("out", "either"):
            adj.setdefault(a, set()).add(b)
        if direction in ("in", "either"):
            adj.setdefault(b, set()).add(a)
    return adj


@pytest.fixture(scope="module")
def g(spark):
    return from_rows(spark, EDGES)


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_uniform_agrees_with_python(spark):
    row = spark.range(1).select(uniform(42, F.lit(5), 7).alias("u")).first()
    assert row.u == uniform_value(42, 5, 7) and 0 <= row.u < 1


def test_geometric_means(spark):
    u = spark.range(20000).select(uniform(1, "id").alias("u"))
    a, b = u.select(F.avg(geometric(F.col("u"), 0.25)), F.avg(geometric_continue(F.col("u"), 0.6))).first()
    assert abs(a - 4) < 0.15 and abs(b - 2.5) < 0.1 and geometric_value(0.0, 0.5) > 1


def test_bernoulli_fraction_and_closure(g):
    n = g.edges.count()
    kept = sa.edge_sample(g, 0.5).edges.count()
    assert abs(kept - n / 2) < 4 * math.sqrt(n / 4)
    s = sa.node_sample(g, 0.5)
    ids = {r.id for r in s.vertices.collect()}
    assert pairs(s.edges) == sorted(e for e in EDGES if e[0] in ids and e[1] in ids)


def test_samples_do_not_depend_on_partitions(g):
    again = type(g)(g.vertices.repartition(7), g.edges.repartition(3))
    assert pairs(sa.edge_sample(g, 0.3).edges) == pairs(sa.edge_sample(again, 0.3).edges)
    assert pairs(sa.edge_by_vertex_sample(g, 0.3).edges) == pairs(sa.edge_by_vertex_sample(again, 0.3).edges)


def test_edge_by_vertex_sizes(g):
    got = {r.id: r.degree for r in degrees(sa.edge_by_vertex_sample(g, 0.3).edges, "out").collect()}
    assert got == {a: math.floor(8 * 0.3 + 0.5) for a in range(40)}


def test_parallel_edges_are_told_apart(spark):
    g = from_rows(spark, [(1, 2)] * 400)
    assert 120 < sa.edge_sample(g, 0.5).edges.count() < 280
    assert {r.occ for r in occurrences(g.edges).collect()} == set(range(1, 401))


def test_ranks_of_a_hub_in_slices(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), uniform(3, "id").alias("u"), "id")
    plain = {r.id: r["rank"] for r in rank_within(rows, "k", F.col("u"), "u", "id").collect()}
    cut = {r.id: r["rank"] for r in rank_within(rows, "k", F.col("u"), "u", "id", hub_rows=60).collect()}
    assert plain == cut


def test_smallest_is_exact(spark):
    rows = spark.range(997).select("id", uniform(3, "id").alias("u"))
    want = sorted((r.u, r.id) for r in rows.collect())[: int(997 * 0.37)]
    assert sorted((r.u, r.id) for r in smallest(rows, "u", 0.37, "id").collect()) == want
    assert sa.uniform_subset(rows.select("id"), 0.25).count() == 249


def test_reservoir_and_repeats(g, spark):
    items = spark.range(50).select(F.lit(1).alias("k"), "id")
    assert sa.reservoir_sample(items, "k", "id", 0.25).count() == 13
    with pytest.raises(ValueError):
        sa.reservoir_sample(items, "k", "id", 1.5)
    a, b = sa.repeat(sa.edge_sample, g, 0.3, 2)
    assert pairs(a.edges) != pairs(b.edges)
    assert {r.sample_id for r in sa.edge_samples(g, 0.3, 3).collect()} == {0, 1, 2}


def test_unknown_samplers(g):
    with pytest.raises(ValueError):
        sa.sampler("forest fire")
    assert sa.sampler(sa.SampleKind.NONE)(g, 0.1, 1) is g


def test_cocitation(spark):
    m1, m3 = from_rows(spark, [(1, 2), (1, 2), (2, 3), (3, 1), (3, 3)]), from_rows(spark, [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)])
    weights = lambda g, q: {r.id: r.weight and round(r.weight, 4) for r in sa.cocitation_weights(g, q).collect()}
    assert weights(m1, 1) == {1: 1.0, 2: 0.0, 3: 0.6667}
    got = weights(m3, 1)
    assert got[1] == 1.0 and got[2] == 0.6667 and {got[v] for v in (3, 4, 5, 6)} == {0.0}
    assert (1, 2) in pairs(sa.cocitation_sample(m1, 1).edges)
    assert set(pairs(sa.cocitation_intersect_sample(m3, 1).edges)) >= {(1, 2), (1, 3)}
    lone = weights(from_rows(spark, [(1, 2)], [1, 2]), 2)
    assert lone[2] is None  # 0 / 0


def test_split(spark):
    d = spark.createDataFrame([(1, 1), (2, 2), (3, 10), (4, 11)], "id bigint, degree bigint")
    sparse, dense = split_by_degree(d)
    assert {r.id for r in sparse.collect()} == {1, 2} and {r.id for r in dense.collect()} == {3, 4}
    assert {r.id for r in split_by_degree(d, "mllib")[0].collect()} == {1, 2}
    sparse, dense = split_by_degree(d.withColumn("degree", F.lit(3)))
    assert sparse.count() == 0 and dense.count() == 4


def test_layered_keeps_dense(g):
    d = degrees(g.edges)
    sparse, dense = split_by_degree(d)
    s = sa.layered_sample(g, 0.2, sparse, dense)
    ids = {r.id: r.attr for r in s.vertices.collect()}
    assert {r.id for r in dense.collect()} <= set(ids)
    assert all(ids[r.id] == r.degree for r in d.collect() if r.id in ids)


@pytest.mark.parametrize("direction", ["either", "out"])
def test_neighbours_of_a_hub_are_numbered_in_the_same_order(spark, monkeypatch, direction):
    g = from_rows(spark, [*EDGES, *((7, 100 + k % 60) for k in range(200)), *((200 + k, 7) for k in range(90))])
    rows = lambda: sorted(map(tuple, wl.numbered_neighbors(g.edges, direction).select("id", "place", "other", "n", "n_other").collect()), key=str)
    plain, walks = rows(), sorted(map(str, wl.doubling_walk(g, 6, 2).collect()))
    scores = sorted(map(str, wl.ppr_monte_carlo(g, 20, 0.3).collect()))
    monkeypatch.setattr("vertexlens.operators.ranking.HUB_ROWS", 10)
    assert rows() == plain and sorted(map(str, wl.doubling_walk(g, 6, 2).collect())) == walks
    assert sorted(map(str, wl.ppr_monte_carlo(g, 20, 0.3).collect())) == scores


def test_a_hub_is_dealt_over_several_salts(spark, monkeypatch):
    g = from_rows(spark, [*EDGES, *((7, 100 + k) for k in range(200)), *((100 + k, 3) for k in range(50))])
    rows = lambda: [{r[0]: round(r[1], 9) for r in df.collect()} for df in (rk.pagerank(g, 3), rk.pagerank_until(g, 0.01), rk.kcore_heuristic(g, 8))]
    pairs_of = lambda: {(r.source, r.target): round(r.score, 9) for r in rk.ppr_exact(g, 0.2, 3).collect()}
    plain, exact = rows(), pairs_of()
    monkeypatch.setattr(rk, "HUB_LINKS", 25)
    assert rk.by_source(g.edges).hubs.count() == 1
    assert rows() == plain and pairs_of() == exact


def test_chains_keep_their_statistic_up_to_date(g):
    src, dst = map(list, zip(*EDGES))
    r = random.Random(1)
    for direction in ("either", "in", "out"):
        for evaluation in wk.Evaluation:
            adj = adjacency(src, dst, direction)
            back = adjacency(dst, src, direction)
            s = wk._Subset(set(range(0, 40, 2)), adj, back, direction, evaluation)
            for _ in range(60):
                s.swap(r.choice(sorted(s.chosen)), r.choice([v for v in range(40) if v not in s.chosen]))
                assert s.statistic() == wk._Subset(s.chosen, adj, back, direction, evaluation).statistic()


def test_walks(spark):
    g = from_rows(spark, EDGES)
    near = {frozenset(e) for e in EDGES}
    for length, theta in ((7, 3), (6, 3), (5, 1), (4, 9)):
        for walk in (wl.sqrt_walk, wl.doubling_walk):
            rows = walk(g, length, theta).collect()
            assert len(rows) == 40
            for r in rows:
                assert len(r.path) == length + 1 and r.path[0] == r.source
                assert all(frozenset(h) in near for h in zip(r.path, r.path[1:]))


def test_walks_end_at_isolated_vertices(spark):
    g = from_rows(spark, [(1, 2)], [1, 2, 3])
    assert {r.source: len(r.path) for r in wl.doubling_walk(g, 4, 2).collect()} == {1: 5, 2: 5, 3: 1}


def test_monte_carlo_sums(spark):
    g = from_rows(spark, EDGES)
    total = sum(wl.walk_lengths(4, 0.2, 42))
    for r in wl.ppr_monte_carlo(g, 20, 0.2).groupBy("source").agg(F.sum("score").alias("s")).collect():
        assert abs(r.s - (total + 4) / total) < 1e-9
    assert wl.ppr_monte_carlo(g, 20, 0.2, per_source_length=True).select("source").distinct().count() == 40


def test_single_walkers(g):
    for f, kind, target in ((wk.random_walk_sample, "edge", int(0.2 * len(EDGES))), (wk.random_jump_sample, "edge", int(0.2 * len(EDGES))), (wk.random_jump_vertices, "vertex", 12)):
        rows = f(g, 0.3 if kind == "vertex" else 0.2, samples=2).collect()
        for s in (0, 1):
            assert len([r for r in rows if r.sample_id == s and r.kind == kind]) == target
        assert {(r.src, r.dst) for r in rows if r.kind == "edge"} <= set(EDGES)
    with pytest.raises(ValueError):
        wk.random_walk_sample(g, 0.2, most_edges=10)


def test_metropolis(g):
    rows = wk.metropolis_sample(g, 0.3, 15, 5.0, chains=2).collect()
    for s in (0, 1):
        own = [r for r in rows if r.sample_id == s]
        chosen = g.vertices.where(F.col("id").isin([r.id for r in own]))
        assert len(own) == 12
        assert abs(wk.subset_norm(g, chosen).first()["norm"] - own[0].norm) < 1e-9
    rows = wk.metropolis_sample(g, 0.3, 5, 5.0, "out", wk.Evaluation.CLUSTERING).collect()
    chosen = g.vertices.where(F.col("id").isin([r.id for r in rows]))
    assert abs(wk.subset_norm(g, chosen, "out", wk.Evaluation.CLUSTERING).first()["norm"] - rows[0].norm) < 1e-9
    assert wk.metropolis_sample(g, 0.0, 5, 5.0).count() == 0


def test_swaps_match_recomputation(g):
    from vertexlens.operators.clustering import local_clustering, set_degrees

    chosen = g.vertices.where("id < 20")
    swapped = g.vertices.where("id < 20 and id <> 4 or id = 30")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(wk.swapped_degrees(g, set_degrees(g, "either", chosen), chosen, 30, 4)) == rows(set_degrees(g, "either", swapped))
    got = wk.swapped_coefficients(g, local_clustering(g, "either", chosen), chosen, 30, 4)
    assert rows(got) == rows(local_clustering(g, "either", swapped))
    assert dict(rows(wk.with_vertex(set_degrees(g, "either", chosen), 77, degree=5)))[77] == 5


def test_edit_distance():
    for a, b, d in (([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [1, 3, 2], 2), ([1, 2, 3], [4, 5, 6], 6), ([1, 2, 3], [], 3), ([1, 2, 3, 4], [2, 3, 9, 4], 2)):
        assert edit_distance(a, b) == d


def test_arrays(spark):
    row = spark.range(1).select(
        max_pair(F.array(F.struct(F.lit(1).alias("id"), F.lit(7).alias("attr")))).alias("m"),
        max_pair(F.array().cast("array<struct<id:int,attr:int>>")).alias("e"),
        random_element(F.array(F.lit(1), F.lit(2)), F.lit(0.6)).alias("r"),
        random_subset(F.sequence(F.lit(1), F.lit(9)), 4, 1).alias("s"),
        random_subset(F.sequence(F.lit(1), F.lit(3)), 9, 1).alias("all"),
    ).first()
    assert (row.m, row.e, row.r) == (7, -1, 2) and len(set(row.s)) == 4 and sorted(row.all) == [1, 2, 3]


def test_bloom(spark, tmp_path):
    ids = spark.range(300)
    f = BloomFilter.build(ids.where("id % 3 = 0"), 4096, 3)
    got = {r.id: r.might_contain for r in f.test(ids).collect()}
    assert all(got[i] for i in range(0, 300, 3)) and sum(got.values()) < 150
    sized = BloomFilter.sized(ids.where("id % 3 = 0"), 0.01)
    assert (sized.m, sized.k) == (959, 7) and sum(r.might_contain for r in sized.test(spark.range(1000, 3000)).collect()) < 60
    f.save(str(tmp_path / "f"))
    again = BloomFilter.load(spark, str(tmp_path / "f"), 4096, 3).add(spark.range(1, 2))
    assert {r.id: r.might_contain for r in again.test(ids).collect()}[1]


def test_bloom_hashes_an_id_once_however_often_it_occurs(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    positions = BloomFilter.positions

    def counted(ids, m, k, seed):
        made.add(ids.count())
        return positions(ids, m, k, seed)

    monkeypatch.setattr(BloomFilter, "positions", staticmethod(counted))
    ids = spark.range(600).select((F.col("id") % 30).alias("id"))
    f = BloomFilter.sized(ids, 0.01)
    assert made.value == 30 and f.m == BloomFilter.sized(spark.range(30), 0.01).m
    assert all(r.might_contain for r in f.test(ids).collect())
    assert {r.pos for r in f.bits.collect()} == {r.pos for r in positions(ids, f.m, f.k, 42).collect()}
