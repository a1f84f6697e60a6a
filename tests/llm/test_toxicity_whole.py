"""Toxicity learns from every labelled document, in any number of shards."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from test_models import corpus, labels_of
from vertexlens.llm import toxicity


def test_every_labelled_document_is_learned_from(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(12_000)] + [(5, "a later text"), (None, "no id")])
    docs = docs.withColumn("lang", F.lit("en"))
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    again = labels.where("doc_id < 10").withColumn("toxic", F.lit(1))
    rows = toxicity.labelled(docs, labels.unionByName(again), "toxic", F.col("doc_id") % 5 != 0, ("lang",)).collect()
    assert len(rows) == 9_600 and all(r.label == (1 if r.doc_id < 10 else r.doc_id % 2) and r.lang == "en" for r in rows)
    whole = toxicity.labelled(docs, labels, "toxic", F.lit(True)).collect()
    assert len(whole) == 12_000 and next(r for r in whole if r.doc_id == 5).text == "a later text"


def test_shards_learn_together(spark, docs_of):
    rows = corpus(1500)
    docs, labels = docs_of([r[:3] for r in rows]), labels_of(spark, rows)
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    p = toxicity.CnnParams(shard_docs=150)
    net = toxicity.train(docs, labels, "toxic", learnable, p)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == r[4] for r in held) > 0.95 * len(held)
    again = toxicity.train(docs.repartition(5), labels, "toxic", learnable, p)
    assert np.allclose(again.emb, net.emb) and np.allclose(again.thresholds, net.thresholds)
