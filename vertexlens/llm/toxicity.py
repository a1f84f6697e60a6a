"""Toxicity: a small convolutional network over hashed words, trained in numpy.

A word is a few hashed features: itself and its first 4 to 9 bytes (so inflected forms share a part). Features have
rows in a hashed table of embeddings, everything not in the table the zero row; a word's vector is their maximum by
component. Filters of several widths run
over the words, each is max-pooled over the whole text, and a logistic layer reads the pooled values. Thresholds are
calibrated per language, and shift the score so that 0.5 is every language's threshold. Which languages there are and how
their words look is learned from the labelled documents; a text's language is then told from the text alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import bounded_batches, broadcast_if_small, crc_mod, cut_lineage, id_and_bytes, table
from vertexlens.llm.textbytes import LOWER, U64, Block, SpanHash, blocks, byte_table, owner, runs

_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
#: Letters and non-ASCII characters make words here, so junk around a word does not hide it.
_WORD = byte_table(range(97, 123)) | _HIGH
_PREFIXES = (0, 4, 5, 6, 7, 9)
@dataclass(frozen=True)
class CnnParams:
    """table: slots of the hashed embedding table; language_table: of the table of words by language (powers of two).

    Every labelled document is learned from: in one shard per shard_docs of them, each trained on its own in an epoch; then
    the nets are averaged, `fan` at a time, on the executors. The strongest feature keeps a contested slot. A language with
    fewer than least_calibrated documents held out of fitting, or fewer than five toxic ones, takes the threshold of all.
    """

    shard_docs: int = 10_000
    fan: int = 32
    table: int = 1 << 16
    language_table: int = 1 << 13
    least_docs: int = 4
    least_odds: float = 0.7
    dim: int = 4
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 4
    epochs: int = 6
    rate: float = 0.05
    holdout: int = 4
    least_calibrated: int = 40
    seed: int = 3


def word_features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashes[words, features]) of the block's words, whole texts."""
    buf = LOWER[b.buf]
    ws, we = runs(_WORD[buf])
    h = SpanHash(buf)
    columns = [h(ws, np.minimum(ws + n, we) if n else we) ^ U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1) for k, n in enumerate(_PREFIXES)]
    return owner(b, ws), np.stack(columns, 1) if len(ws) else np.zeros((0, len(_PREFIXES)), U64)


def language_slots(h: np.ndarray, p: CnnParams) -> np.ndarray:
    """Slots of whole words in the table that tells languages apart."""
    return (h[:, 0] >> U64(40) & U64(p.language_table - 1)).astype(np.int64)


@dataclass
class ToxicityNet:
    p: CnnParams
    slots: np.ndarray = None  # row number per table slot
    tags: np.ndarray = None  # full hash that owns the slot
    emb: np.ndarray = None  # rows x dim, row 0 zero
    filters: list[np.ndarray] = field(default_factory=list)  # per width: (width * dim, filters)
    bias: list[np.ndarray] = field(default_factory=list)
    dense: np.ndarray = None
    offset: float = 0.0
    thresholds: np.ndarray = None  # logit for no language, then for each of langs
    langs: list[str] = field(default_factory=list)
    words: np.ndarray = None  # language_table x langs: log share of a slot's words in the language

    def rows(self, h: np.ndarray) -> np.ndarray:
        at = (h & U64(self.p.table - 1)).astype(np.int64)
        return np.where(self.tags[at] == h, self.slots[at], 0)

    def pooled(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled filter values per text and the word where each maximum is; rows[words, features]."""
        pad = max(self.p.widths) - 1
        n, d = len(start), self.p.dim
        # `pad` zero words and one more after each text; filters begin at its words or at the first zero, so none sees two texts
        length = end - start + pad + 1
        first = np.cumsum(length) - length
        x = np.zeros((int(length.sum()) + pad, d), np.float32)
        doc = np.repeat(np.arange(n), end - start)
        x[first[doc] + np.arange(len(rows)) - start[doc]] = self.emb[rows].max(1) if len(rows) else 0
        places = end - start + 1
        bounds = np.stack([first, first + places], 1).ravel()
        values, where = [], []
        for w, f, c in zip(self.p.widths, self.filters, self.bias):
            m = int(length.sum())
            y = np.zeros((m + 1, f.shape[1]), np.float32)
            for k in range(w):
                y[:m] += x[k : k + m] @ f[k * d : (k + 1) * d]
            v = np.maximum.reduceat(y, bounds, axis=0)[::2] if n else np.zeros((0, f.shape[1]), np.float32)
            values.append(v + c)
            if self._training:
                where.append(np.stack([[a + int(y[a : a + s, j].argmax()) for j in range(f.shape[1])] for a, s in zip(first, places)]))
        self._x = x if self._training else None
        return np.maximum(np.concatenate(values, 1), 0), where

    _training = False
    _x = None

    def logits(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.pooled(rows, start, end)[0] @ self.dense + self.offset

    def language(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text 1 + the place of its likeliest language, or 0 without a word or without languages; texts are words at[i]:at[i + 1]."""
        n, told = np.diff(at), np.zeros(len(at) - 1, np.int64)
        full = np.flatnonzero(n)
        if len(full) and self.langs:
            slots = language_slots(h, self.p)
            likely = [np.add.reduceat(column[slots], at[full], dtype=np.float64) for column in np.ascontiguousarray(self.words.T)]
            told[full] = 1 + np.argmax(likely, 0)
        return told

    def score(self, b: Block) -> np.ndarray:
        doc, h = word_features(b)
        at = np.searchsorted(doc, np.arange(len(b.start) + 1))
        z = self.logits(self.rows(h), at[:-1], at[1:]) - self.thresholds[self.language(h, at)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def known_rows(net: ToxicityNet, h: np.ndarray) -> np.ndarray:
    """Table rows of a text's words, cut to those that a filter can tell from nothing: known words and their surroundings.

    All other places are zero vectors under every filter, as are the zero words that pooled() puts after each text.
    """
    rows = net.rows(h) if len(h) else np.zeros((0, len(_PREFIXES)), np.int64)
    return rows[_near(rows.any(1), max(net.p.widths))].astype(np.int32)


def _near(known: np.ndarray, w: int) -> np.ndarray:
    out = known.copy()
    for k in range(1, w):
        out[:-k] |= known[k:]
        out[k:] |= known[:-k]
    return out


def with_table(features: np.ndarray, odds: np.ndarray, languages: dict[str, np.ndarray], p: CnnParams) -> ToxicityNet:
    """A net whose table has the features, at most one for each slot, and which tells the languages apart by their words.

    An embedding begins as the feature's smoothed log-odds over documents, in its first component. Maxima never see
    features that speak against toxicity, so those get no slot.
    """
    net, r = ToxicityNet(p), np.random.default_rng(p.seed)
    used = (features & U64(p.table - 1)).astype(np.int64)
    net.slots, net.tags = np.zeros(p.table, np.int32), np.zeros(p.table, U64)
    net.slots[used] = np.arange(1, len(used) + 1)
    net.tags[used] = features
    net.langs = sorted(languages)
    seen = np.stack([languages[x] for x in net.langs], 1) + 1.0 if languages else np.ones((p.language_table, 0))
    net.words = np.log(seen / seen.sum(0)).astype(np.float32)
    net.emb = np.zeros((len(used) + 1, p.dim), np.float32)
    net.emb[1:, 0] = odds
    net.emb[1:, 1:] = r.normal(0, 0.05, (len(used), p.dim - 1))
    for w in p.widths:
        f = r.normal(0, 0.1, (w * p.dim, p.filters)).astype(np.float32)
        f[0 :: p.dim, 0] = 1 / w  # one filter of each width begins as the mean evidence of its words
        net.filters.append(f)
        net.bias.append(np.zeros(p.filters, np.float32))
    net.dense = r.normal(0, 0.05, len(p.widths) * p.filters).astype(np.float32)
    net.dense[:: p.filters] = 0.3
    net.offset = -1.0
    net.thresholds = np.zeros(len(net.langs) + 1)
    return net


def _parameters(net: ToxicityNet) -> list[np.ndarray]:
    return [net.emb, *net.filters, *net.bias, net.dense, np.array([net.offset])]


def _moved(net: ToxicityNet, flat: np.ndarray) -> ToxicityNet:
    """A copy of the net with the parameters of `flat`, all in a row."""
    at, parts = 0, []
    for x in _parameters(net):
        parts.append(flat[at : at + x.size].reshape(x.shape).astype(x.dtype))
        at += x.size
    k = len(net.filters)
    return replace(net, emb=parts[0], filters=parts[1 : 1 + k], bias=parts[1 + k : 1 + 2 * k], dense=parts[-2], offset=float(parts[-1][0]))


def averaged(nets: DataFrame, shards: int, fan: int) -> tuple[float, np.ndarray]:
    """(rows, mean parameters weighted by rows) of nets(shard, n, net): `fan` neighbouring shards are summed by a task until one sum is left.

    Sums are of doubles, in order of the shard, so neither the number of tasks nor their order tells on the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((shard, n, bytes(net)) for b in batches for shard, n, net in zip(*(c.to_pylist() for c in b.columns)))
        for group, own in itertools.groupby(held, lambda x: x[0] // fan):
            n, total = 0.0, 0.0
            for _, m, net in own:
                n, total = n + m, total + np.frombuffer(net, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["shard", "n", "net"])

    while True:
        shards = -(-shards // fan)
        nets = nets.repartitionById(shards, F.floor(F.col("shard") / fan).cast("int")).mapInArrow(run, "shard bigint, n double, net binary")
        if shards == 1:
            r = nets.first()
            return r["n"], np.frombuffer(bytes(r["net"]), np.float64) / r["n"]


def fit(net: ToxicityNet, rows: DataFrame, y_mean: float | None, shards: int) -> ToxicityNet:
    """Trains on rows(label, held, grp, rows), a partition per shard, in its order. Documents in `held` only calibrate thresholds.

    In an epoch every shard goes on from the same net; one net, the average, comes to the driver, and goes out again.
    """
    p, spark = net.p, rows.sparkSession
    for epoch in range(p.epochs if y_mean is not None and 0 < y_mean < 1 else 0):
        sent = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n = _moved(sent.value, np.concatenate([x.ravel().astype(np.float64) for x in _parameters(sent.value)])), 0
            r = np.random.default_rng([p.seed, epoch])
            known, y = [], []

            def steps() -> None:
                for part in np.array_split(r.permutation(len(y)), max(1, len(y) // 64)):
                    _step(own, [known[i] for i in part], np.array([y[i] for i in part]), p.rate / (1 + epoch))

            for batch in batches:
                for label, x in zip(batch.column("label").to_pylist(), batch.column("rows").to_pylist()):
                    known.append(np.frombuffer(x, np.int32).reshape(-1, len(_PREFIXES)))
                    y.append(label)
                    n += 1
                    if len(y) == p.shard_docs:
                        steps()
                        known, y = [], []
            if y:
                steps()
            if n:
                flat = np.concatenate([x.ravel().astype(np.float64) for x in _parameters(own)]) * n
                shard = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([float(n)]), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "net"])

        found = rows.where("not held").select("label", "rows").mapInArrow(run, "shard bigint, n double, net binary")
        net = _moved(net, averaged(found, shards, p.fan)[1])
        sent.unpersist()
    return _calibrate(net, rows)


def _step(net: ToxicityNet, rows: list[np.ndarray], y: np.ndarray, rate: float) -> None:
    """One gradient step on a batch: the maxima pass their gradient to the words under the winning filter place."""
    p = net.p
    lens = np.array([len(x) for x in rows])
    end = np.cumsum(lens)
    flat = np.concatenate(rows)
    net._training = True
    pooled, where = net.pooled(flat, end - lens, end)
    net._training = False
    x, d = net._x, p.dim
    z = pooled @ net.dense + net.offset
    err = (1 / (1 + np.exp(-z)) - y).astype(np.float32) / len(y)
    grad = err[:, None] * net.dense * (pooled > 0)
    net.dense -= rate * 10 * (err @ pooled)
    net.offset -= rate * 10 * float(err.sum())
    gx = np.zeros_like(x)
    for k, w in enumerate(p.widths):
        g = grad[:, k * p.filters : (k + 1) * p.filters]
        for j in range(p.filters):
            at = where[k][:, j]
            for i in range(w):
                f = net.filters[k][i * d : (i + 1) * d, j]
                np.add.at(gx, at + i, g[:, j : j + 1] * f)
                net.filters[k][i * d : (i + 1) * d, j] -= rate * (g[:, j] @ x[at + i])
        net.bias[k] -= rate * g.sum(0)
    length = lens + max(p.widths)
    first = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(lens)), lens)
    place = first[doc] + np.arange(len(flat)) - (end - lens)[doc]
    touched = np.flatnonzero(np.abs(gx[place]).sum(1))
    win = net.emb[flat[touched]].argmax(1)  # the feature that each component of a word's vector came from
    for c in range(d):
        np.add.at(net.emb[:, c], flat[touched, win[:, c]], -rate * gx[place[touched], c])
    net.emb[0] = 0


def _calibrate(net: ToxicityNet, rows: DataFrame) -> ToxicityNet:
    """Per language the logit of best F1 on all documents held out of fitting (on all, without any); small groups take that of all.

    Logits are counted to 1/1000, within 40 of zero: what comes to the driver is bounded, however many documents there are.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [np.frombuffer(x, np.int32).reshape(-1, len(_PREFIXES)) for x in batch.column("rows").to_pylist()]
            if known:
                end = np.cumsum([len(x) for x in known])
                z = sent.value.logits(np.concatenate(known), np.concatenate([[0], end[:-1]]), end)
                yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("label"), pa.array(np.round(np.clip(z.astype(np.float64), -40, 40) * 1000).astype(np.int64))], ["grp", "label", "z"])

    use = rows.where("held") if not rows.where("held").isEmpty() else rows
    scored = use.select("grp", "label", "rows").mapInArrow(run, "grp bigint, label double, z bigint")
    found = scored.groupBy("grp", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()
    grp, z, n, y = (np.array([r[c] for r in found], kind) for c, kind in (("grp", np.int64), ("z", np.float64), ("n", np.float64), ("y", np.float64)))

    def best(own: np.ndarray) -> float:
        levels, at = np.unique(-z[own] / 1000, return_inverse=True)
        level, docs, hit = -levels, np.cumsum(np.bincount(at, n[own])), np.cumsum(np.bincount(at, y[own]))
        k = int((2 * hit / (docs + hit[-1])).argmax())
        return float((level[k] + level[k + 1]) / 2 if k + 1 < len(level) else level[k] - 0.1)

    every = np.ones(len(z), bool)
    overall = best(every) if len(z) and 0 < y.sum() < n.sum() else 0.0
    thresholds = np.zeros(len(net.langs) + 1)
    for g in range(len(thresholds)):
        own = grp == g
        enough = n[own].sum() >= net.p.least_calibrated and 5 <= y[own].sum() < n[own].sum()
        thresholds[g] = best(own) if enough else overall
    return replace(net, thresholds=thresholds)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, label and the columns of `keep` of every learnable document with a label.

    If a document has several labels the largest counts; if several rows have its id, the one of least text. Null ids have no
    label. The labels are joined: broadcast if they are few by count, else by a shuffle that Spark splits where an id is hot.
    """
    chosen = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    rows = docs.select("doc_id", F.struct("text", *keep).alias("_row")).join(broadcast_if_small(cut_lineage(chosen)), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min("_row").alias("_row"))
    return one.select("doc_id", "_row.text", "label", *(F.col(f"_row.`{c}`") for c in keep))


def language_evidence(sample: DataFrame, p: CnnParams) -> dict[str, np.ndarray]:
    """lang -> how often each slot's words occur in its documents of the sample: one row of fixed size per language and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            for b in blocks(batch.column("body")):
                doc, h = word_features(b)
                langs = np.array(batch.column("lang").to_pylist()[b.first : b.last])[doc]
                slots = language_slots(h, p)
                for x in set(langs.tolist()):
                    found[x] = found.get(x, 0) + np.bincount(slots[langs == x], minlength=p.language_table)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v.astype(np.int64).tobytes() for v in found.values()], pa.binary())], ["lang", "n"])

    total: dict[str, np.ndarray] = {}
    for r in sample.where("lang is not null").select("lang", "body").mapInArrow(run, "lang string, n binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["n"], np.int64)
    return total


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, p: CnnParams = CnnParams()) -> ToxicityNet:
    """Fits on all labelled documents, in passes over them: the words of their languages, the documents per feature, the documents as table rows.

    docs has doc_id, text and lang; lang tells which thresholds there are, and is learned from, but never read for a score.
    Features are counted where the documents are; the driver sees the strongest of each table slot, and the known words.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("body")
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(p.holdout)) == 0
    sample = cut_lineage(labelled(bounded_batches(docs), labels, label, learnable, ("lang",)).select("doc_id", "label", held.alias("held"), body, "lang"))
    fitted = sample.where("not held")  # what calibrates thresholds gives no evidence to the table
    spark = docs.sparkSession

    def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("body")):
                doc, h = word_features(b)
                at = np.searchsorted(doc, np.arange(len(b.start) + 1))
                y = np.asarray(batch.column("label"))[b.first : b.last] > 0
                sets = [np.unique(h[i:j]) for i, j in itertools.pairwise(at)]
                u, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                tox = np.bincount(inverse, np.repeat(y, [len(x) for x in sets]), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(tox)], ["u", "n", "tox"])

    share = fitted.agg(F.avg("label")).first()[0]
    prior = float(np.clip(0.5 if share is None else share, 1e-3, 1 - 1e-3))
    counts = fitted.mapInArrow(feature_counts, "u bigint, n bigint, tox bigint").groupBy("u").agg(F.sum("n").alias("n"), F.sum("tox").alias("tox"))
    odds = F.log((F.col("tox") + 4 * prior) / (F.col("n") - F.col("tox") + 4 * (1 - prior))) - float(np.log(prior / (1 - prior)))
    strong = counts.withColumn("odds", odds).where((F.col("tox") >= 2) & (F.col("n") >= p.least_docs) & (F.col("odds") > p.least_odds))
    best = strong.groupBy(F.col("u").bitwiseAND(F.lit(p.table - 1)).alias("slot")).agg(F.max(F.struct("odds", "u")).alias("best"))
    found = sorted((r["slot"], r["best"]["u"], r["best"]["odds"]) for r in best.collect())  # at most p.table rows
    net = with_table(np.array([u for _, u, _ in found], np.int64).view(U64), np.array([o for *_, o in found]), language_evidence(sample, p), p)
    sent = spark.sparkContext.broadcast(net)

    def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for b in blocks(batch.column("body")):
                doc, h = word_features(b)
                at = np.searchsorted(doc, np.arange(len(b.start) + 1))
                packed = [known_rows(net, h[i:j]).tobytes() for i, j in itertools.pairwise(at)]
                part = slice(b.first, b.last)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("label")[part], batch.column("held")[part], pa.array(net.language(h, at), pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "label", "held", "grp", "rows"])

    n, y_mean = fitted.agg(F.count(F.lit(1)), F.avg("label")).first()
    shards = max(1, -(-n // p.shard_docs))
    mixed = F.xxhash64("doc_id", F.lit(17))
    rows = sample.mapInArrow(as_rows, "doc_id bigint, label double, held boolean, grp bigint, rows binary").withColumn("_u", mixed)
    rows = rows.repartitionById(shards, F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(shards)).cast("int")).sortWithinPartitions("_u", "doc_id")
    return fit(net, cut_lineage(rows), y_mean, shards)


def scored(docs: DataFrame, net: ToxicityNet) -> DataFrame:
    """doc_id, score of every row's whole text; null and empty texts have no words and score as such.

    Repeated rows stay repeated and score alike; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # table and filters: independent of the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            parts = [net.score(b) for b in blocks(batch.column(1), 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return id_and_bytes(docs).mapInArrow(run, "doc_id bigint, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, and has no label to learn from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    net = train(docs, labels, "toxic", ~held_out)
    return scored(docs, net).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
