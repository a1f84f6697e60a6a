"""Tasks of derived graphs and links: as many as the rows call for, whatever the session's shuffles."""

import random
from collections import Counter

import pytest

from vertexlens import graph
from vertexlens.operators import ranks as rk
from vertexlens.sources import fixtures
from vertexlens.sources.edges import from_rows


@pytest.fixture
def many_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def edges():
    r = random.Random(8)
    return [(r.randrange(40), r.randrange(40)) for _ in range(300)]


def test_pairs_of_an_order_are_dealt_by_rows(spark, monkeypatch):
    r = random.Random(3)
    lines = [(i // 4, r.randrange(30)) for i in range(400)]
    monkeypatch.setattr(fixtures, "PAIRED_ROWS", 20)
    found = fixtures.bought_together(spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint"))
    assert found.rdd.getNumPartitions() == 20
    parts = {}
    for o, p in lines:
        parts.setdefault(o, set()).add(p)
    assert sorted(map(tuple, found.collect())) == sorted({(a, b) for s in parts.values() for a in s for b in s if a < b})


def test_few_links_are_in_few_partitions_and_rounds_stay_there(spark, edges, many_shuffles):
    g = from_rows(spark, edges)
    links = rk.by_source(g.edges, stay=g.vertices)
    assert links.few and links.rows.rdd.getNumPartitions() == links.parts < 16
    assert {(r.src, r.dst): r.c for r in links.rows.collect()} == {**{(v, v): 0 for e in edges for v in e}, **Counter(edges)}
    links.unpersist()
    found, sent = rk.pagerank_active(g, 0.02)
    one, alike = rk.pagerank_active(g, 0.02, cut_every=5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    usual, same = rk.pagerank_active(g, 0.02, cut_every=1)
    assert sent == alike == same and min(sent) > 0
    scores = [{r.id: round(r.score, 9) for r in x.collect()} for x in (found, one, usual)]
    assert scores[0] == scores[1] == scores[2]


def test_peeling_writes_no_edge_again(spark, edges, many_shuffles, monkeypatch):
    written, cut = [], graph.cut_and_observe
    monkeypatch.setattr(graph, "cut_and_observe", lambda df, **m: written.append(df.columns) or cut(df, **m))
    monkeypatch.setattr(rk, "cut_lineage", lambda df, cut=rk.cut_lineage: written.append(df.columns) or cut(df))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for k in (9, 13):
        left = set(near)
        while weak := {v for v in left if len(near[v] & left) < k}:
            left -= weak
        assert {r.id for r in rk.kcore(from_rows(spark, edges), k).collect()} == left
    assert written and not any({"id", "other"} <= set(c) for c in written)
