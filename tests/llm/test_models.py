import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vertexlens.llm import langid, quality, toxicity
from vertexlens.llm.quality import BoostedTrees, BoostParams


def corpus(n=600, seed=1):
    r = random.Random(seed)
    sounds = {"aa": ["the", "ing", "ou", "sh"], "bb": ["cion", "ez", "ña", "qu"], "cc": ["sch", "ung", "ä", "keit"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(sounds))
        words = ["".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 120))]
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        if toxic:
            words[r.randrange(len(words))] = {"aa": "grumpf", "bb": "zlot", "cc": "wurbel"}[lang] + r.choice(["", "ing", "ez"])
        if junk:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, int(not junk), int(toxic)))
    return rows


def test_languages(docs_of):
    rows = corpus()
    docs = docs_of([r[:3] for r in rows] + [(9000, None), (9001, "123 ..."), (9002, "")])
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    found = langid.learn(docs, learnable)
    assert set(found) == {"aa", "bb", "cc"}
    got = {r.doc_id: r for r in langid.classify(docs.withColumn("lang_pred", F.lit("x")), found).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) > 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and not got[i].lang_accepted and got[i].lang_score == 0 for i in (9000, 9001, 9002))
    assert all(0 <= r.lang_score <= 1 for r in got.values())


def test_languages_without_labels(docs_of):
    docs = docs_of([(1, "abc", None), (2, None, "aa")])
    found = langid.learn(docs, F.lit(True))
    assert found == {} and {r.lang_pred for r in langid.classify(docs, found).collect()} == {"und"}
    assert langid.classify(docs_of([]), {"aa": b"x" * 20}).count() == 0


def test_short_and_long_texts_use_the_whole(docs_of):
    found = {"aa": langid.prepared("the thing of the sheep and the ship " * 40), "bb": langid.prepared("cion ezcion la cionqu ña ez " * 40)}
    c = langid.Compressors(found, langid.LangIdParams())
    mixed = "the thing of the sheep " * 300 + "cion ezcion la cionqu ña ez " * 900
    assert c.classify(mixed)[0] == "bb" and c.classify("the")[0] == "aa"


def test_boosting():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = BoostedTrees(x[:2000], y[:2000], BoostParams(trees=40))
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = BoostedTrees(x[:10], np.ones(10))
    assert (one.score(x) > 0.99).all()
    assert np.allclose(BoostedTrees(np.zeros((0, 5)), np.zeros(0)).score(x), 0.5)


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs_of):
    rows = corpus()
    docs = docs_of([r[:3] for r in rows] + [(9000, None), (9001, ""), (9001, "")])
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.train(docs, labels_of(spark, rows), "quality", learnable)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.3) == r[3] for r in held) > 0.97 * len(held)
    assert got[9000] == got[9001] and 0 <= got[9000] <= 1
    assert quality.scored(docs_of([]), model).count() == 0


def test_toxicity(spark, docs_of):
    rows = corpus(1500)
    docs = docs_of([r[:3] for r in rows] + [(9000, None), (9001, "")])
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    net = toxicity.train(docs, labels_of(spark, rows), "toxic", learnable)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == r[4] for r in held) > 0.95 * len(held)
    assert got[9000] == got[9001] < 0.5
    again = toxicity.train(docs.repartition(5), labels_of(spark, rows), "toxic", learnable)
    assert np.allclose(again.emb, net.emb) and np.allclose(again.dense, net.dense)


def test_no_labels_at_all(spark, docs_of):
    docs, labels = docs_of([(1, "a b c")]), labels_of(spark, [])
    assert toxicity.scored(docs, toxicity.train(docs, labels, "toxic", F.lit(True))).count() == 1
    assert quality.scored(docs, quality.train(docs, labels, "quality", F.lit(True))).first().score == 0.5
