"""Micro-graphs with values worked out by hand or by an independent model in this file."""

import random

import pytest
from pyspark.sql import functions as F

from vertexlens.graph import Graph, aggregate_messages, degrees, neighbor_attrs, neighbor_ids
from vertexlens.operators import clustering as cl
from vertexlens.operators import ranks as rk
from vertexlens.operators import sampling as sa
from vertexlens.operators.components import connected_components
from vertexlens.sources.edges import append_csv, canonical_edges, from_rows, read_delimited_edges, read_edge_list, read_graph, write_graph

M1 = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 3)]
M2 = [(0, 1), (0, 2), (0, 3), (0, 4)]
M3 = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def as_map(df, key="id", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


def close(got, want, digits=4):
    assert {k: round(v, digits) for k, v in got.items()} == {k: round(v, digits) for k, v in want.items()}


def test_degrees_and_neighbours(spark):
    g = from_rows(spark, M1)
    assert as_map(degrees(g.edges)) == {1: 3, 2: 3, 3: 4}
    assert as_map(neighbor_ids(g, "out")) == {1: [2, 2], 2: [3], 3: [1, 3]}
    assert as_map(neighbor_ids(g, "either", distinct=True)) == {1: [2, 3], 2: [1, 3], 3: [1, 2, 3]}
    assert as_map(neighbor_attrs(g, "in"))[2] == [(1, 1), (1, 1)]
    with pytest.raises(ValueError):
        neighbor_ids(g, "both")


def test_messages_and_triplets(spark):
    g = from_rows(spark, M1).map_vertices(F.col("id").cast("int"))
    got = as_map(aggregate_messages(g, F.sum, to_src=F.col("dst_attr"), to_dst=F.col("src_attr")))
    assert got == {1: 2 + 2 + 3, 2: 1 + 1 + 3, 3: 2 + 1 + 3 + 3}


def test_isolated_vertices(spark):
    g = from_rows(spark, [(1, 2)], vertices=[1, 2, 3])
    assert sorted(as_map(sa.node_sample(g, 1.1).vertices)) == [1, 2, 3]
    assert sorted(as_map(sa.edge_sample(g, 1.1).vertices)) == [1, 2]
    assert as_map(connected_components(g)) == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize(
    "edges, want",
    [
        (M1, {1: 0.636698, 2: 0.672294, 3: 1.188978}),
        (M2, {0: 0.15, 1: 0.181875, 2: 0.181875, 3: 0.181875, 4: 0.181875}),
        (M3, {1: 0.15, 2: 0.21375, 3: 0.395437, 4: 0.486122, 5: 0.356602, 6: 0.659713}),
    ],
)
def test_pagerank(spark, edges, want):
    close(as_map(rk.pagerank(from_rows(spark, edges), 10)), want, 6)


def test_triangles_and_clustering(spark):
    g1, g3 = from_rows(spark, M1), from_rows(spark, M3)
    assert as_map(cl.triangles(g1)) == {1: 1, 2: 1, 3: 1}
    assert set(as_map(cl.triangles(g3)).values()) == {1}
    close(as_map(cl.local_clustering(g1), value="cc"), {1: 1.5, 2: 1.5, 3: 1.1667})
    close(as_map(cl.local_clustering(g1, "out"), value="cc"), {1: 0, 2: 0, 3: 2.0})
    close(as_map(cl.local_clustering(g1, "in"), value="cc"), {1: 0, 2: 0, 3: 2.0})
    close(as_map(cl.local_clustering(g3, "out"), value="cc"), {1: 1.0, 2: 0, 3: 0, 4: 1.0, 5: 0, 6: 0})
    close(as_map(cl.local_clustering(g3, "in"), value="cc"), {1: 0, 2: 0, 3: 1.0, 4: 0, 5: 0, 6: 1.0})
    close(as_map(cl.global_clustering(g1)), {1: 0.3333, 2: 0.3333, 3: 0.1667})
    close(as_map(cl.degree_cumavg(cl.set_degrees(g1)), "degree"), {2: 2.0, 3: 1.5})
    close(as_map(cl.degree_cumavg(cl.set_degrees(g3, "out")), "degree"), {0: 1.0, 1: 2.0, 2: 2.0})


@pytest.mark.parametrize("edges, k, core, degenerate", [(M1, 2, {1, 2, 3}, set()), (M1, 3, set(), {1, 2}), (M2, 2, {0}, {1, 2, 3, 4}), (M3, 2, {1, 2, 3, 4, 5, 6}, {1, 2, 5, 6}), (M3, 3, set(), {1, 2, 3, 4, 5, 6})])
def test_heuristic_cores(spark, edges, k, core, degenerate):
    g = from_rows(spark, edges)
    ones = lambda df: {v for v, x in as_map(df).items() if x == 1}
    assert ones(rk.kcore_heuristic(g, k)) == core
    assert ones(rk.kdegenerate_heuristic(g, k)) == degenerate


def test_labels_without_message_stay(spark):
    assert as_map(rk.kdegenerate_heuristic(from_rows(spark, [(0, 1), (1, 0), (2, 0)]), 1)) == {0: 0, 1: 0, 2: 1}
    g = from_rows(spark, [(0, 0), (1, 0)])
    assert as_map(rk.kdegenerate_heuristic(g, 2)) == {0: 0, 1: 1}
    assert as_map(rk.kdegenerate_heuristic(g, 2, rounds=14))[0] == 1


def _model(edges, k, at_least, rounds=15):
    ids = {v for e in edges for v in e}
    out = {v: sum(a == v for a, _ in edges) for v in ids}
    holds = (lambda x: x >= k) if at_least else (lambda x: x <= k)
    label = {v: int(holds(out[v])) for v in ids}
    for _ in range(rounds):
        mail = {}
        for a, b in edges:
            if label[a]:
                mail[b] = mail.get(b, 0) + 1
        label = {v: int(holds(out[v] + mail[v])) if v in mail else label[v] for v in ids}
    return label


def test_heuristic_cores_against_model(spark):
    r = random.Random(5)
    for k, at_least in ((2, True), (2, False)):
        edges = [(r.randrange(10), r.randrange(10)) for _ in range(18)]
        g = from_rows(spark, edges)
        assert as_map((rk.kcore_heuristic if at_least else rk.kdegenerate_heuristic)(g, k)) == _model(edges, k, at_least)


def test_textbook_core(spark):
    assert {r.id for r in rk.kcore(from_rows(spark, M3), 2).collect()} == {1, 2, 3, 4, 5, 6}
    assert rk.kcore(from_rows(spark, M3), 3).count() == 0
    assert {r.id for r in rk.kdegenerate(from_rows(spark, [*M3, (6, 7)]), 1).collect()} == {7}


def test_pagerank_until_and_ppr(spark):
    got = as_map(rk.pagerank_until(from_rows(spark, [(1, 2), (2, 1)]), 1e-6))
    close(got, {1: 1.0, 2: 1.0}, 3)
    ppr = rk.ppr_exact(from_rows(spark, [(1, 2), (2, 1)]), 0.5, 40)
    total = {r["source"]: r["s"] for r in ppr.groupBy("source").agg(F.sum("score").alias("s")).collect()}
    close(total, {1: 1.0, 2: 1.0}, 6)


def test_ppr_of_some_sources_is_part_of_that_of_all(spark):
    g = from_rows(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (4, 2)])
    pairs = lambda df: {(r.source, r.target): round(r.score, 9) for r in df.collect()}
    every = pairs(rk.ppr_exact(g, 0.2, 6))
    chosen = spark.createDataFrame([(2,), (4,), (4,), (99,), (None,)], "id bigint")
    assert pairs(rk.ppr_exact(g, 0.2, 6, sources=chosen)) == {k: v for k, v in every.items() if k[0] in (2, 4)}


def test_links_are_released(spark):
    spark.catalog.clearCache()
    rk.pagerank(from_rows(spark, [(1, 2), (2, 3), (3, 1)]), 3).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    g = from_rows(spark, [*zip(ids, ids[1:]), (100, 101), (200, 200)])
    got = as_map(connected_components(g))
    assert {got[i] for i in ids} == {0} and got[101] == 100 and got[200] == 200


def test_edge_files(spark, tmp_path):
    f = tmp_path / "edges.txt"
    f.write_text("# comment\n1 2\n2\t3 9\n\n3   1\n")
    assert sorted((r.src, r.dst) for r in read_edge_list(spark, str(f)).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert (1, 3) in {(r.src, r.dst) for r in read_edge_list(spark, str(f), canonical=True).collect()}
    t = tmp_path / "edges.tsv"
    t.write_text("1\t2\n1\t3\n2\t3\n")
    edges, signatures = read_delimited_edges(spark, str(t))
    assert edges.count() == 3 and as_map(signatures) == {1: 2, 2: 1}
    g = Graph.from_edges(edges)
    write_graph(g, str(tmp_path / "g"))
    assert read_graph(spark, str(tmp_path / "g")).edges.count() == 3
    append_csv(signatures, str(tmp_path / "out"))
    append_csv(signatures, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out")).count() == 4
    assert canonical_edges(edges).count() == 3
