"""Held-out figures on the largest test tables, and edge rows of the learned operators."""

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vertexlens.llm import langid, quality, toxicity
from vertexlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.exists(f"{SF}/labels.parquet"), reason="test tables are not there")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, first = np.unique(score[order], return_index=True)
    ends = np.append(first[1:], len(score))
    rank = np.empty(len(score))
    rank[order] = np.repeat((first + 1 + ends) / 2, ends - first)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@needs_tables
@pytest.mark.parametrize(("query", "label", "least_auc", "least_accuracy"), [("op2_quality_classifier", "quality", 0.99, 0.98), ("op9_toxicity", "toxic", 0.94, 0.96)])
def test_labels_held_out(spark, query, label, least_auc, least_accuracy):
    truth = {d: y for d, y in zip(*(pq.read_table(f"{SF}/labels.parquet").column(c).to_pylist() for c in ("doc_id", label)))}
    rows = [r for r in QUERIES[query](spark, SF).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    y, score = np.array([truth[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    accuracy = np.mean([r.predicted == t for r, t in zip(rows, y)])
    print(f"\n{query}: {len(rows)} rows, {int(y.sum())} of label 1, AUC {auc(score, y):.4f}, accuracy {accuracy:.4f}")
    assert auc(score, y) > least_auc and accuracy > least_accuracy


@needs_tables
def test_languages_held_out(spark):
    truth = dict(zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang"))))
    rows = [r for r in QUERIES["op7_language_id"](spark, SF).collect() if r.held_out and truth[r.doc_id] is not None]
    right = np.mean([r.lang_pred == truth[r.doc_id] for r in rows])
    print(f"\nop7_language_id: {len(rows)} rows, accuracy {right:.4f}, accepted {np.mean([r.lang_accepted for r in rows]):.4f}")
    assert right > 0.99


def test_a_sample_is_bounded_by_rows(spark, docs_of):
    docs = docs_of([(1, f"text {i % 7}", "aa") for i in range(3000)] + [(i, "other", "bb") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40)] * 2 + [(None, 1)], "doc_id bigint, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10, ("lang",)).collect()
    assert len(rows) == 10 and len({r.doc_id for r in rows}) == 10
    whole = quality.labelled_sample(docs, labels, "quality", F.lit(True), 100, ("lang",)).collect()
    assert len(whole) == 39 and next(r for r in whole if r.doc_id == 1).text == "text 0"


def test_repeated_ids_reach_the_driver_once(docs_of):
    docs = docs_of([(1, f"the thing {i}", "aa") for i in range(2000)] + [(None, "the thing", "aa")] * 50 + [(k, "cion ez qu", "bb") for k in range(2, 300)])
    found = langid.learn(docs, F.lit(True), langid.LangIdParams(sample_docs=20))
    assert found["aa"] == langid.prepared("the thing 0").ljust(16) and len(found["bb"]) < 20 * 12


def test_any_number_of_languages(docs_of):
    rows = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{'xyzwq'[j % 5]}" for j in range(i, i + 30)), f"l{k}") for k in range(230) for i in range(2)]
    found = langid.learn(docs_of(rows), F.lit(True))
    assert len(found) == 230
    got = {r.doc_id: r.lang_pred for r in langid.classify(docs_of(rows[::40]), found).collect()}
    assert all(got[i] == lang for i, _, lang in rows[::40])


def test_scores_have_no_jump_at_any_length():
    found = {"aa": langid.prepared("the thing of the sheep and the ship " * 40), "bb": langid.prepared("cion ezcion la cionqu ña ez " * 40)}
    c = langid.Compressors(found, langid.LangIdParams())
    r = random.Random(1)
    text = " ".join("".join(r.choice(["sheep", "ing", "cion", "ou", "an", "qu"]) for _ in range(r.randrange(1, 4))) for _ in range(900))
    assert len(text) > 4400
    sizes = [c.sizes(text[:n]) for n in range(300, 4400)]
    assert max(abs(x - y) for a, b in zip(sizes, sizes[1:]) for x, y in zip(a, b)) <= 24
    margins = [c.classify(text[:n])[2] for n in range(300, 4400)]
    assert max(abs(a - b) for a, b in zip(margins, margins[1:])) < 0.05


@pytest.mark.parametrize("long", [2_000_000])
def test_odd_rows_of_the_classifiers(spark, docs_of, long):
    text = ("the ing ou sh " * (long // 14))[:long]
    rows = [(i, f"the ing {'grumpf ' if i % 3 == 0 else ''}{i} ou", "aa") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(rows)
    odd = docs_of([(5, text), (5, text), (5, "same"), (5, "same"), (None, "same"), (None, None), (8, "")])
    odd = odd.withColumn("score", F.lit("x")).withColumn("body", F.lit(1)).withColumn("label", F.lit("y"))
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(docs.withColumn("label", F.lit("z")), labels, label, F.lit(True))
        got = module.scored(odd, model).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r.score)
        assert len(by[5]) == 4 and len(set(by[5])) <= 2 and min(by[None]) in by[5] or max(by[None]) in by[5]
        assert module.scored(docs_of([]), model).count() == 0
    told = langid.classify(odd, {"aa": langid.prepared("the ing ou sh " * 20), "bb": langid.prepared("cion ez " * 20)})
    assert [r.lang_pred for r in told.collect()][:2] == ["aa", "aa"] and "score" in told.columns


def test_a_tie_goes_to_the_language_of_more_documents():
    same = langid.prepared("the thing of the sheep " * 20)
    assert langid.Compressors({"zz": same, "aa": same}, langid.LangIdParams()).classify("the sheep")[:2] == ("zz", 0.5)
