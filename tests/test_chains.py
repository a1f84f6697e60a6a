"""Chains whose graph streams to their task: the rows of a plain walk, and nothing of the graph on the driver."""

import random

import pytest

from vertexlens.functions.rng import uniform_value
from vertexlens.graph import Graph, ends
from vertexlens.operators import walkers as wk
from vertexlens.operators.triangles import unpack

_R = random.Random(5)
#: Parallel edges, loops, sinks (50 to 59) and vertices without edges (90 to 94).
EDGES = [(_R.randrange(50), _R.randrange(60)) for _ in range(260)] * 2 + [(7, 8)] * 40
IDS = [*range(60), *range(90, 95)]


@pytest.fixture
def g(spark, monkeypatch):
    """A graph that cannot be brought to the driver as a table."""

    def refuse(self):
        raise AssertionError("a table came to the driver")

    g = Graph(spark.createDataFrame([(v, 1) for v in IDS], "id bigint, attr int"), spark.createDataFrame([(a, b, 1) for a, b in EDGES], "src bigint, dst bigint, attr int"))
    monkeypatch.setattr(type(g.edges), "toPandas", refuse)
    return g


def plain(sample, target, edges, back, home_moves, every=100_000, seed=42):
    out = {v: sorted(b for a, b in EDGES if a == v) for v in IDS}
    draw = lambda what, among: among[int(uniform_value(seed, sample, step, what) * len(among))]
    step = 0
    here = home = draw("start", IDS)
    vertices, links = {here}, set()
    while len(links if edges else vertices) < target:
        step += 1
        if uniform_value(seed, sample, step, "jump") < back:
            here = home if home_moves else draw("to", IDS)
        if home_moves and step % every == 0:
            here = home = draw("home", IDS) if here == home else here
        if out[here]:
            nxt = draw("step", out[here])
            links.add((here, nxt))
            here = nxt
        elif home_moves:
            here = home = draw("sink", IDS) if here == home else home
        else:
            here = draw("sink", IDS)
        vertices.add(here)
    return [(sample, "edge", a, b) for a, b in sorted(links)] + [(sample, "vertex", v, None) for v in sorted(vertices)]


def same(rows, *expected):
    assert sorted(map(tuple, rows.collect()), key=str) == sorted((r for e in expected for r in e), key=str)


def test_random_walk_streams(g):
    target = int(0.2 * len(EDGES))
    for every in (100_000, 30):
        same(wk.random_walk_sample(g, 0.2, samples=3, jump_every=every), *(plain(s, target, True, 0.15, True, every) for s in range(3)))


def test_random_jump_sample_streams(g):
    same(wk.random_jump_sample(g, 0.3, samples=2), *(plain(s, int(0.3 * len(EDGES)), True, 0.15, False) for s in range(2)))


def test_random_jump_vertices_streams(g):
    same(wk.random_jump_vertices(g, 0.7, samples=2), *(plain(s, int(0.7 * len(IDS)), False, 0.15, False) for s in range(2)))


def test_metropolis_streams(g):
    for direction in ("either", "out", "in"):
        for evaluation in wk.Evaluation:
            rows = wk.metropolis_sample(g, 0.4, 12, 5.0, direction, evaluation, chains=2).collect()
            for s in (0, 1):
                own = [r for r in rows if r.sample_id == s]
                adj = {v: set() for v in IDS}
                for a, b in EDGES:
                    for x, y in ((a, b),) * (direction != "in") + ((b, a),) * (direction != "out"):
                        adj[x].add(y)
                sets = [wk._Subset(set(x), adj, adj, direction, evaluation).statistic() for x in ([r.id for r in own], IDS)]
                assert len(own) == int(0.4 * len(IDS)) and {r.norm for r in own} == {wk._norm(*sets, evaluation)}


@pytest.fixture
def short_runs(spark, monkeypatch):
    """Packed runs of a few links."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(wk, "_PACKED", 7)
    spark.conf.set(name, 5)
    yield
    spark.conf.set(name, before)


def test_links_are_packed_in_order(g, short_runs):
    pairs = [p for a, b in EDGES for p in ((a, b), (b, a))]
    for distinct, links in ((False, sorted(pairs)), (True, sorted(set(pairs)))):
        found = [[], []]
        rows = sorted(map(tuple, wk._packed(g, [ends(g.edges, "either")], distinct).collect()))
        for kind, *_, blob in rows:
            found[kind] += zip(*(c.tolist() for c in unpack(bytes(blob), 2)))
        assert found == [[(v, 0) for v in IDS], links] and len(rows) > 20


def test_metropolis_shuffles_no_sets(g, short_runs, monkeypatch):
    """The neighbour sets and the graph's degrees come from the packed links, which the chains share."""

    def refuse(*_):
        raise AssertionError("neighbour sets are shuffled")

    whole = [sorted(map(tuple, wk.metropolis_sample(g, 0.4, 12, 5.0, "in", chains=n).collect())) for n in (3, 1)]
    monkeypatch.setattr(wk, "neighbor_sets", refuse)
    monkeypatch.setattr(wk, "set_degrees", refuse)
    again = sorted(map(tuple, wk.metropolis_sample(g, 0.4, 12, 5.0, "in", chains=3).collect()))
    assert again == whole[0] and [r for r in again if r[0] == 0] == whole[1]


def test_jump_vertices_over_short_runs(g, short_runs):
    same(wk.random_jump_vertices(g, 0.7, samples=2), *(plain(s, int(0.7 * len(IDS)), False, 0.15, False) for s in range(2)))


def test_jump_sample_over_short_runs(g, short_runs):
    same(wk.random_jump_sample(g, 0.3, samples=2), *(plain(s, int(0.3 * len(EDGES)), True, 0.15, False) for s in range(2)))


def test_no_vertices_no_rows(spark):
    none = Graph.from_edges(spark.createDataFrame([], "src bigint, dst bigint"))
    assert wk.metropolis_sample(none, 0.4, 5, 5.0).count() == 0 and wk.random_jump_vertices(none, 0.5).count() == 0
