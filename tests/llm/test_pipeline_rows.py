from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
C = " ".join(f"gamma{i}" for i in range(60))
ITEM = " ".join(f"item{i}" for i in range(20))
BAD = C + " " + ITEM
PASSAGE = " ".join(f"again{i}" for i in range(50))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("rows")
    pq.write_table(pa.table({"item_id": [1], "text": [ITEM]}), d / "benchmark.parquet")
    return str(d)


def counted(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_by_row(spark, docs_of, folder):
    rows = [(5, A), (5, B), (3, A), (None, A + " end"), (None, C), (None, C + " end"), (None, C), (7, None), (7, ""), (7, None), (None, None), (None, None), (None, " ")]
    got = counted(corpus_pipeline.near_dedup(spark, docs_of(rows, "en"), folder))
    c = [(None, C), (None, C + " end")]
    assert sum(got.pop(x, 0) for x in c) == 1
    assert got == Counter({(5, B): 1, (3, A): 1, (7, None): 1, (7, ""): 1, (None, None): 2, (None, " "): 1})


def test_decontamination_by_row(spark, docs_of, folder):
    rows = [(5, A), (5, BAD), (None, BAD), (None, A), (None, B), (None, None), (6, BAD), (6, BAD), (8, C), (8, C)]
    got = counted(corpus_pipeline.decontamination(spark, docs_of(rows, "en"), folder))
    assert got == Counter({(5, A): 1, (None, A): 1, (None, B): 1, (None, None): 1, (8, C): 2})


def test_repeated_passages_by_row(spark, docs_of, folder):
    rows = [(5, A), (5, B + " " + PASSAGE), (None, C + " " + PASSAGE), (None, "short"), (None, None)]
    got = counted(corpus_pipeline.repeated_passages(spark, docs_of(rows, "en"), folder))
    assert {i for i, _ in got} == {5, None} and sum(got.values()) == 5
    assert got[(5, A)] == got[(None, "short")] == got[(None, None)] == 1
    cut = {t for _, t in got if t and (t.startswith("beta") or t.startswith("gamma"))}
    assert len(cut) == 2 and not any("again25" in t for t in cut)


def test_language_and_packing_by_row(spark, docs_of, folder):
    learnt = [(i, " ".join(f"{w}{i}{k}" for k in range(40)), lang) for i in range(60) for w, lang in (("the", "en"), ("cion", "es"))]
    own = [(500, "the1 the2 the3 the4 " * 9, "en"), (500, "cion1 cion2 cion3 cion4 " * 9, "es"), (None, "the5 the6 the7 the8 " * 9, "en"), (None, "cion5 cion6 cion7 cion8 " * 9, "es")]
    told = corpus_pipeline.language_id(spark, docs_of(learnt + own), folder)
    got = {(r.doc_id, r.text): r.lang for r in told.collect() if r.doc_id in (500, None)}
    assert got == {(i, t): lang for i, t, lang in own}
    packed = corpus_pipeline.packing(spark, docs_of([(5, A), (5, A + " end"), (None, A), (None, A), (None, None)]), folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == Counter({(5, 61): 1, (5, 62): 1, (None, 61): 2, (None, 0): 1})
