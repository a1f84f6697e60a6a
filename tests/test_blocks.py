"""PageRank over links in blocks: the same scores as by rows, and no row for each edge."""

import random

import pytest

from vertexlens.graph import Graph
from vertexlens.operators import blocks
from vertexlens.operators import ranks as rk
from vertexlens.sources.edges import from_rows


def edges_of(seed, n=600, vertices=40):
    r = random.Random(seed)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(vertices)]
    return [(ids[0] if k % 5 == 0 else r.choice(ids), ids[1] if k % 7 == 0 else r.choice(ids)) for k in range(n)]


def by_hand(edges, rounds, init=0.15, extra=(), tolerance=None):
    out = {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    score = dict.fromkeys({v for e in edges for v in e} | set(extra), init)
    for _ in range(rounds):
        new = dict.fromkeys(score, 0.0)
        for a, b in edges:
            new[b] += score[a] / out[a]
        new = {v: 0.15 + 0.85 * x for v, x in new.items()}
        moved, score = max(abs(new[v] - score[v]) for v in new), new
        if tolerance is not None and moved <= tolerance:
            break
    return score


def scores(rows):
    found = [(r.id, r.score) for r in rows.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


@pytest.fixture
def small_blocks(monkeypatch):
    """Several shares, several pieces of a block, several merges of a share."""
    for name, n in (("LEAST_LINKS", 20), ("MOST_LINKS", 40), ("PORTION_LINKS", 7), ("PIECE_LINKS", 20), ("HELD", 3), ("BATCH", 4), ("MOST_NUMBERS", 99)):
        monkeypatch.setattr(blocks, name, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_give_the_scores_of_the_definition(spark, small_blocks, seed):
    edges = edges_of(seed)
    g = from_rows(spark, edges)
    assert blocks.pays(g) == 4
    assert scores(rk.pagerank(g, 7)) == pytest.approx(by_hand(edges, 7), abs=1e-12)
    assert scores(rk.pagerank_until(g, 0.1)) == pytest.approx(by_hand(edges, 200, 1.0, tolerance=0.1), abs=1e-12)


def test_vertices_without_edges_have_scores_too(spark, small_blocks):
    edges = edges_of(3)
    g = from_rows(spark, edges)
    more = g.vertices.unionByName(spark.createDataFrame([(5, 1), (-6, 1)], "id bigint, attr int"))
    assert scores(rk.pagerank(Graph(more, g.edges), 3)) == pytest.approx(by_hand(edges, 3, extra=(5, -6)), abs=1e-12)


def test_few_edges_a_vertex_null_ids_and_no_edges_go_by_rows(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(60)]
    g = from_rows(spark, edges)
    monkeypatch.setattr(blocks, "MOST_NUMBERS", 1)
    assert blocks.pays(g) is None
    assert scores(rk.pagerank(g, 4)) == pytest.approx(by_hand(edges, 4), abs=1e-12)
    assert scores(rk.pagerank_until(g, 0.1)) == pytest.approx(by_hand(edges, 200, 1.0, tolerance=0.1), abs=1e-12)
    monkeypatch.undo()
    assert blocks.pays(g) == 1
    assert blocks.pays(Graph.from_edges(spark.createDataFrame([(1, None), (1, 2)], "src bigint, dst bigint"))) is None
    assert blocks.pays(Graph.from_edges(spark.createDataFrame([], "src bigint, dst bigint"))) is None


def test_a_round_shuffles_no_row_for_an_edge(spark, monkeypatch):
    monkeypatch.setattr(rk, "_surfer", lambda *a: pytest.fail("a row for each edge"))
    edges = edges_of(4, 3000, 30)
    g = from_rows(spark, edges)
    built = blocks.Blocks.of(g, 2)
    assert built.rows.count() == 4 and built.shares.count() == 2
    assert built.spread(built.filled(0.15), 0.15).count() == 2
    built.unpersist()
    assert scores(rk.pagerank(g, 10)) == pytest.approx(by_hand(edges, 10), abs=1e-12)


def test_python_gets_a_long_row_alone_and_the_session_keeps_its_batches(spark, small_blocks, monkeypatch):
    """All rows of a share in one batch are as long as the graph has vertices, in the JVM and again in Python."""
    monkeypatch.setattr(blocks, "BATCH_BYTES", 1)
    frame, limit = type(spark.range(0)), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    plain = frame.mapInArrow

    def watched(self, f, *schema):
        def run(batches):
            def checked():
                for b in batches:
                    assert b.num_rows == 1, f"{b.num_rows} rows in a batch"
                    yield b

            return f(checked())

        return plain(self, run, *schema)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    edges = edges_of(6, 200)
    g = from_rows(spark, edges)
    assert scores(rk.pagerank(g, 3)) == pytest.approx(by_hand(edges, 3), abs=1e-12)
    assert scores(rk.pagerank_until(g, 0.1)) == pytest.approx(by_hand(edges, 200, 1.0, tolerance=0.1), abs=1e-12)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
