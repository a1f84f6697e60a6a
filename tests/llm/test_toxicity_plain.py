"""The convolutional net against plain loops, its steps against numeric gradients, and shards without number."""

import copy
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import corpus, labels_of
from vertexlens.llm import frames, toxicity
from vertexlens.llm.toxicity import CnnParams, averaged, with_table


def small_net(seed=1):
    r = np.random.default_rng(seed)
    p = CnnParams(table=64, dim=3, filters=2, widths=(1, 2), language_table=16, seed=seed)
    net = with_table(np.arange(1, 40, dtype=np.uint64), r.normal(0, 1, 39), {}, p)
    for x in (net.emb, *net.filters, *net.bias, net.dense):
        x += r.normal(0, 0.3, x.shape).astype(np.float32)
    net.emb[0] = 0
    return net


def some_rows(seed, n):
    r = np.random.default_rng(seed)
    return [r.integers(0, 40, (k, 6)).astype(np.int32) for k in r.integers(0, 9, n)]


def plain_logit(net, rows):
    """One text, word by word: a word is the maximum of its features, filters slide over the words and the zeros after them."""
    p = net.p
    words = [np.max([net.emb[k] for k in row], axis=0) for row in rows]
    words += [np.zeros(p.dim)] * (2 * max(p.widths))
    pooled = []
    for w, f, bias in zip(p.widths, net.filters, net.bias):
        for j in range(p.filters):
            values = [sum(float(words[i + k] @ f[k * p.dim : (k + 1) * p.dim, j]) for k in range(w)) for i in range(len(rows) + max(p.widths))]
            pooled.append(max(0.0, max(values) + float(bias[j])))
    return float(np.dot(pooled, net.dense)) + net.offset


def test_logits_against_plain_loops():
    net, rows = small_net(), some_rows(2, 40)
    end = np.cumsum([len(x) for x in rows])
    got = net.logits(np.concatenate(rows), np.concatenate([[0], end[:-1]]), end)
    assert np.allclose(got, [plain_logit(net, x) for x in rows], atol=1e-4)
    alone = [net.logits(x, np.array([0]), np.array([len(x)]))[0] for x in rows]
    assert np.allclose(got, alone, atol=1e-5)  # whatever stands beside a text


def test_a_step_goes_down_the_gradient():
    """What a step takes from each parameter, by its rate, is the numeric derivative of the mean log loss."""
    net, rows = small_net(4), some_rows(5, 12)
    for x in ("emb", "dense"):
        setattr(net, x, getattr(net, x).astype(np.float64))
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.bias]
    y = (np.arange(12) % 3 == 0).astype(float)

    def loss(n):
        z = np.array([plain_logit(n, x) for x in rows])
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    after = copy.deepcopy(net)
    toxicity._step(after, rows, y, 1e-3)

    def checked(name, k, scale):
        x, new = (getattr(n, name) if k is None else getattr(n, name)[k] for n in (net, after))
        for at in np.ndindex(x.shape):
            if name == "emb" and at[0] == 0:
                continue
            ends = []
            for d in (1e-4, -1e-4):
                moved = copy.deepcopy(net)
                (getattr(moved, name) if k is None else getattr(moved, name)[k])[at] += d
                ends.append(loss(moved))
            assert abs((x[at] - new[at]) / 1e-3 / scale - (ends[0] - ends[1]) / 2e-4) < 2e-3, (name, k, at)

    for k in range(2):
        checked("filters", k, 1)
        checked("bias", k, 1)
    checked("dense", None, 10)
    checked("emb", None, 1)


@pytest.mark.parametrize("fan", [2, 7, 100])
def test_nets_are_averaged_in_a_tree(spark, fan):
    r = np.random.default_rng(3)
    nets = [(i, float(r.integers(1, 50)), r.normal(size=5)) for i in range(45) if i != 11]  # a shard without rows
    df = spark.createDataFrame([(i, n, (x * n).tobytes()) for i, n, x in nets], "shard bigint, n double, net binary").repartition(6)
    n, mean = averaged(df, 45, fan)
    assert n == sum(m for _, m, _ in nets)
    assert np.allclose(mean, np.average([x for *_, x in nets], axis=0, weights=[m for _, m, _ in nets]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_more_shards_than_any_bound_and_joined_labels(spark, docs_of, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(frames, "BROADCAST_BYTES", 0)
    rows = corpus(1500)
    docs, labels = docs_of([r[:3] for r in rows]), labels_of(spark, rows)
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    net = toxicity.train(docs, labels, "toxic", learnable, CnnParams(shard_docs=20, fan=4, epochs=3))  # 45 shards, three layers
    got = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == r[4] for r in held) > 0.9 * len(held)
