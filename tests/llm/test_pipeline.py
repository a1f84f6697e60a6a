import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from vertexlens.llm.neardup import NearDupParams, near_duplicates


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(4)
    sounds = {"en": ["the", "ing", "ou", "sh"], "es": ["cion", "ez", "ña", "qu"]}
    prose = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    texts = [(prose(lang, r.randrange(60, 200)), lang) for lang in ("en", "es") for _ in range(60)]
    item, passage = prose("en", 40), prose("es", 80)
    texts += [(texts[3][0] + " end", "en"), (prose("en", 30) + " " + item + " " + prose("en", 30), "en"), (None, "en"), ("12 34", None)]
    texts += [(prose("es", 50) + " " + passage + " " + prose("es", 50), "es") for _ in range(3)]
    d = tmp_path_factory.mktemp("sf")
    ids = list(range(len(texts)))
    pq.write_table(pa.table({"doc_id": ids, "text": [t for t, _ in texts], "lang": [x for _, x in texts], "source": ["s"] * len(ids), "n_chars": [len(t or "") for t, _ in texts]}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), d / "benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    a = corpus_pipeline.language_id(spark, docs, folder)
    kept = {r.doc_id for r in a.collect()}
    assert set(before) - kept == {122, 123}  # null and letterless texts
    b = corpus_pipeline.near_dedup(spark, a, folder)
    groups = {r.doc_id: r.component_id for r in near_duplicates(a, NearDupParams()).collect()}
    assert {r.doc_id for r in b.collect()} == {i for i in kept if groups[i] == i} and groups[120] == 3
    c = corpus_pipeline.repeated_passages(spark, b, folder)
    texts = {r.doc_id: r.text for r in c.collect()}
    assert set(texts) == {r.doc_id for r in b.collect()}
    assert all(len(texts[i]) < len(before[i]) - 150 for i in (124, 125, 126)) and texts[10] == before[10]
    e = corpus_pipeline.decontamination(spark, c, folder)
    assert set(texts) - {r.doc_id for r in e.collect()} == {121}
    for stage in (a, b, c, e):
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    f = corpus_pipeline.packing(spark, e, folder)
    assert {r.doc_id for r in f.collect()} == {r.doc_id for r in e.collect()}


def test_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "repeated passages", "decontamination", "packing"]
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() >= 115
