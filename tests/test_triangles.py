"""Triangles over packed adjacency against plain sets, with every bound made small; nothing of the wedges is written."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vertexlens.graph import Graph
from vertexlens.operators import clustering as cl
from vertexlens.operators import triangles as tr
from vertexlens.operators.sampling import edge_sample
from vertexlens.plans.experiment import run_experiment

_R = random.Random(9)
#: Two hubs with an edge between them, loops, edges both ways and repeated ones; ids of both signs and 60 bits.
EDGES = [(_R.randrange(60), _R.randrange(60)) for _ in range(500)] + [(h, v) for h in (100, 101) for v in range(60)] + [(100, 101), (3, 3)] + [(5, 6)] * 4


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return {v: sum(len(near[v] & near[w]) for w in near[v]) // 2 for v in near}


SMALL = {"ONE_TASK": 10, "TASK_EDGES": 200, "TASK_LINKS": 90}
BOUNDS = [{}, SMALL | {"WEDGES": 7, "CHECKED": 9, "PORTION": 30, "TABLE_SPAN": 0}, {"ONE_TASK": 10, "TASK_EDGES": 1200, "HUB_LINKS": 50, "SLOTS": 1 << 10}]


@pytest.fixture
def bound(monkeypatch):
    def put(bounds):
        for name, value in bounds.items():
            monkeypatch.setattr(tr, name, value)

    return put


@pytest.mark.parametrize("stretch", [1, -(1 << 53)])
@pytest.mark.parametrize("bounds", BOUNDS)
def test_triangles_in_triples_of_colours(spark, bound, bounds, stretch):
    bound(bounds)
    edges = [(a * stretch, b * stretch) for a, b in EDGES]
    g = Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.id: r.triangles for r in cl.triangles(g).collect()} == plain(edges)


def plain_corners(edges, direction):
    """Triangles at each vertex both of whose others are in its neighbour set."""
    near, sets = {}, {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            for v, w in ((a, b),) if direction == "out" else ((b, a),):
                sets.setdefault(v, set()).add(w)
    count = {v: sum(1 for u in s for w in s if u < w and w in near[u]) for v, s in sets.items()}
    return {v: n for v, n in count.items() if n}


@pytest.mark.parametrize("direction", ["in", "out"])
@pytest.mark.parametrize("bounds", BOUNDS)
def test_corners_with_both_others_in_the_set(spark, bound, bounds, direction):
    bound(bounds)
    df = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    assert {r.id: r.triangles for r in tr.corner_counts(df, direction).collect()} == plain_corners(EDGES, direction)


def test_colours_follow_edges_and_hubs(spark, bound):
    assert [tr.colours_for(n, 0) for n in (100, 200_000, 1_000_000, 75_000_000)] == [1, 1, 3, 9]
    assert tr.colours_for(75_000_000, 40_000_000) == 20
    # the shuffled copies grow with the square root of the edges, the edges of a task not at all
    for n in (10**9, 10**12):
        c = tr.colours_for(n, 0)
        assert 6 * n / c**2 <= tr.TASK_EDGES and c < 2.2 * (n / tr.TASK_EDGES) ** 0.5 * 1.2
    bound({"HUB_LINKS": 50})
    df = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    degree = max(sum(v in e for e in EDGES if e[0] != e[1]) for v in (100, 101))
    assert degree <= tr.largest_degree(df, len(EDGES)) <= 4 * degree
    assert tr.largest_degree(df, 40) == 0


def test_no_pair_of_classes_is_crossed_and_edges_move_once(spark, bound):
    """A class is written once and goes to as many triples as there are colours; there is no grid of classes."""
    bound(SMALL)
    df = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    c = tr.colours_for(len(EDGES), 0)
    rows = tr.classes(df, c, False)
    found = rows.collect()
    assert len({(r.x, r.y) for r in found}) == len(found) <= c * (c + 1) // 2 and all(r.x <= r.y for r in found)
    pairs = [p for r in found for p in zip(*(x.tolist() for x in tr.unpack(bytes(r.blob), 2)))]
    assert sorted(pairs) == sorted({(min(e), max(e)) for e in EDGES if e[0] != e[1]})
    assert rows.rdd.getNumPartitions() == c * (c + 1) // 2


def test_packed_numbers():
    r = np.random.default_rng(2)
    x = r.integers(-(1 << 63), (1 << 63) - 1, 1000)
    for back, own in zip(tr.unpack(tr.pack(x, np.sort(x)), 2), (x, np.sort(x))):
        assert (back == own).all()
    assert len(tr.unpack(tr.pack(x[:0]), 1)[0]) == 0


def test_a_triple_of_a_graph_of_some_million_edges_is_small(spark):
    """It was as large as the graph: 4,000,000 of 6,000,000 edges. A larger one's copies stay as they were."""
    for n in (600_000, 3_000_000, 6_000_000, 13_000_000):
        assert 6 * n / tr.colours_for(n, 0) ** 2 <= tr.FEW_EDGES
    for n in (25_000_000, 36_000_000, 75_000_000, 430_000_000):
        assert 6 * n / tr.colours_for(n, 0) ** 2 <= tr.TASK_EDGES and tr.colours_for(n, 0) <= max(9, 2.5 * (n / tr.TASK_EDGES) ** 0.5 + 1)
    edges = np.arange(1_200_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(edges[i : i + 10_000]), pa.array(edges[i : i + 10_000] + 1)], ["src", "dst"]) for i in range(0, len(edges), 10_000)]
    assert max(len(a) for a, _ in tr._portions(iter(batches), tr.TASK_LINKS)) <= 500_000


def test_global_clustering(spark):
    found, degree = plain(EDGES), {}
    for v in (v for e in EDGES for v in e):
        degree[v] = degree.get(v, 0) + 1
    rows = cl.global_clustering(Graph.from_edges(spark.createDataFrame(EDGES, "src bigint, dst bigint"))).collect()
    assert {r.id: round(r.cc, 9) for r in rows} == {v: round(2 * t / (degree[v] * (degree[v] - 1)), 9) if degree[v] > 1 else 0 for v, t in found.items()}


def test_triangle_count_of_vertices_without_edges(spark):
    g = Graph.from_edges(spark.createDataFrame(EDGES, "src bigint, dst bigint"))
    alone = spark.createDataFrame([(7777, 1)], "id bigint, attr int")
    assert {r.id: r.triangles for r in cl.triangles(Graph(g.vertices.unionByName(alone), g.edges)).collect()} == plain(EDGES) | {7777: 0}
    assert cl.triangles(Graph(alone, g.edges.limit(0))).collect() == [(7777, 0)]


def test_experiment_of_triangles(spark):
    g = Graph.from_edges(spark.createDataFrame(EDGES, "src bigint, dst bigint"))
    assert run_experiment(g, "no sampling", 1.0, "triangleCount").first()["metricScore"] == 0
    assert run_experiment(g, "edge", 0.5, "triangleCount").first()["metricScore"] > 0


def test_experiment_over_many_triples(spark, bound):
    """Both graphs' counts lie in a few files, and the error is that of plain counts over the sample's vertices."""
    bound(SMALL | {"TASK_LINKS": 60})
    g = Graph.from_edges(spark.createDataFrame(EDGES, "src bigint, dst bigint"))
    assert tr.corner_counts(g.edges).rdd.getNumPartitions() <= -(-len(EDGES) // 60 // 8) + 1
    whole, part = plain(EDGES), plain([(r.src, r.dst) for r in edge_sample(g, 0.5, 42).edges.collect()])
    error = sum(abs(whole[v] - part[v]) for v in part) / len(part)
    assert abs(run_experiment(g, "edge", 0.5, "triangleCount", seed=42).first()["metricScore"] - error) < 1e-9


def plain_local(edges, direction, chosen=None):
    """(degree, coefficient) by the definition: linked pairs of the neighbour set, loops included."""
    vertices = {v for e in edges for v in e} if chosen is None else chosen
    sets = {v: set() for v in vertices}
    for a, b in edges:
        if a in vertices and b in vertices:
            if direction in ("out", "either"):
                sets[a].add(b)
            if direction in ("in", "either"):
                sets[b].add(a)
    out = {}
    for v, near in sets.items():
        d = len(near)
        pairs = [(u, w) for u in near for w in near if w in sets[u]]
        linked = len(pairs) if direction == "either" else len({(min(p), max(p)) for p in pairs})
        out[v] = (d, round(linked / (d * (d - 1) / (1 if direction == "either" else 2)), 9) if d > 1 else 0.0)
    return out


@pytest.mark.parametrize("direction", ["either", "in", "out"])
@pytest.mark.parametrize("bounds", [{}, SMALL])
def test_local_clustering_without_wedges(spark, bound, bounds, direction):
    bound(bounds)
    edges = EDGES + [(100, 100), (7, 7), (7, 100), (100, 7)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.id: (r.degree, round(r.cc, 9)) for r in cl.local_clustering(g, direction).collect()} == plain_local(edges, direction)
    chosen = set(range(0, 60, 2)) | {100, 101}
    some = spark.createDataFrame([(v,) for v in chosen], "id bigint")
    assert {r.id: (r.degree, round(r.cc, 9)) for r in cl.local_clustering(g, direction, some).collect()} == plain_local(edges, direction, chosen)
