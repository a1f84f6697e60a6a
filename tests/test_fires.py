import math
import random

import pytest
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform_value
from vertexlens.graph import Graph
from vertexlens.operators import fires
from vertexlens.operators.fires import FireParams, forest_fire, forest_fire_sample
from vertexlens.sources.edges import from_rows


def plain(vertices, edges, fraction, seed, p):
    """The burn, one vertex after the other."""
    out, back = {}, {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            back.setdefault(b, set()).add(a)
    wanted = int(fraction * len(vertices))
    burnt, front, i = {}, [], 0
    while len(burnt) < wanted:
        lit = {}
        for v in front:
            for adj, share, way in ((out, p.forward, "out"), (back, p.backward, "in")):
                if share:
                    fan = math.floor(math.log(max(uniform_value(seed, v, way + "fan"), 1e-300)) / math.log(1 - (1 - share)))
                    cold = sorted((uniform_value(seed, v, w, way), w) for w in adj.get(v, ()) if w not in burnt)
                    for _, w in cold[:fan]:
                        lit[w] = min(lit.get(w, burnt[v][1]), burnt[v][1])
        if not lit:
            order = sorted((uniform_value(seed, v, "spark"), v) for v in vertices if v not in burnt)
            lit = {v: v for _, v in order[: min(max(1, int(p.sparks * wanted)), wanted - len(burnt))]}
        order = sorted((uniform_value(seed, v, "last"), v) for v in lit)
        front = [v for _, v in order[: wanted - len(burnt)]]
        burnt |= {v: (i, lit[v]) for v in front}
        i += 1
    return sorted((v, r, f) for v, (r, f) in burnt.items())


def some_graph(seed, n=60, m=220):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(0, i) for i in range(n)] * 2 + [(3, 3)]
    return list(range(n + 6)), edges  # six vertices have no edge


@pytest.mark.parametrize("p", [FireParams(), FireParams(0.7, 0.4, 0.01), FireParams(0.0, 0.0), FireParams(0.0, 0.6, 0.2)])
def test_fires_against_a_plain_burn(spark, monkeypatch, p):
    monkeypatch.setattr(fires, "_JOINED", 3)
    vertices, edges = some_graph(1)
    found = sorted(map(tuple, forest_fire(from_rows(spark, edges, vertices), 0.4, 7, p).collect()))
    assert found == plain(vertices, edges, 0.4, 7, p)
    assert len(found) == int(0.4 * len(vertices))


def test_hubs_are_ranked_in_slices(spark, monkeypatch):
    from vertexlens.operators import ranking

    monkeypatch.setattr(fires, "HUB_ROWS", 20)
    monkeypatch.setattr(ranking, "HUB_ROWS", 20)
    vertices, edges = some_graph(2)
    p = FireParams(0.8, 0.5)
    found = sorted(map(tuple, forest_fire(from_rows(spark, edges, vertices), 0.6, 3, p).collect()))
    assert found == plain(vertices, edges, 0.6, 3, p)


def test_all_none_and_an_empty_graph(spark):
    vertices, edges = some_graph(3)
    g = from_rows(spark, edges, vertices)
    assert {r.id for r in forest_fire(g, 1.0).collect()} == set(vertices)
    assert forest_fire(g, 0.0).collect() == []
    empty = Graph(g.vertices.where("false"), g.edges.where("false"))
    assert forest_fire(empty, 0.5).collect() == []
    with pytest.raises(ValueError):
        forest_fire(g, 0.5, p=FireParams(forward=1.0))


def test_the_sample_is_induced_and_no_task_holds_it(spark):
    vertices, edges = some_graph(4)
    g = from_rows(spark, edges, vertices)
    burnt = {r.id for r in forest_fire(g, 0.5, 9).collect()}
    s = forest_fire_sample(g, 0.5, 9)
    assert {r.id for r in s.vertices.collect()} == burnt
    assert sorted((r.src, r.dst) for r in s.edges.collect()) == sorted((a, b) for a, b in edges if a in burnt and b in burnt)
    plan = s.edges.select(F.col("src"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BatchEvalPython" not in plan
