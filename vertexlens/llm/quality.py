"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and of fixed depth, flattened into three arrays (feature, threshold bin, leaf value), so
scoring a batch is `depth` vectorised numpy steps per tree and no recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import crc_mod, id_and_bytes, table
from vertexlens.llm.stats import MEASURES, measure, measured
from vertexlens.llm.textbytes import blocks


@dataclass(frozen=True)
class BoostParams:
    """sample: labelled documents learned from (those of least hash of doc_id), whatever the corpus size."""

    sample: int = 20_000
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    least_leaf: int = 10


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of statistics from the measures of stats.measure: sizes in logarithm, everything else a ratio."""
    f = {k: v.astype(np.float64) for k, v in m.items()}
    words, size, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_bytes"], 1), np.maximum(f["n_lines"], 1)
    letters = np.maximum(f["n_upper"] + f["n_lower"] + f["n_high"], 1)
    columns = [
        np.log1p(f["n_words"]), np.log1p(f["n_bytes"]), f["word_chars"] / words, f["n_symbols"] / words, f["n_symbols"] / size,
        np.log1p(f["n_lines"]), words / lines, f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["n_distinct_words"] / words,
        f["n_same_as_last"] / words, f["n_upper"] / letters, f["n_digits"] / size, f["n_punct"] / words, f["n_bang"] / words,
        f["n_high"] / size, f["n_stop_words_end"] / words, f["n_short_words"] / words, f["n_long_words"] / words,
        f["n_distinct_words"] / np.sqrt(words),
    ]
    return np.stack(columns, 1)


class BoostedTrees:
    """Binary log-loss boosting on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: BoostParams = BoostParams()):
        self.depth = p.depth
        q = np.linspace(0, 1, p.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, q)) if len(x) else np.zeros(0) for c in x.T]
        b = self.binned(x)
        prior = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(prior / (1 - prior)))
        raw = np.full(len(y), self.base)
        nodes, leaves = (1 << p.depth) - 1, 1 << p.depth
        self.feature = np.zeros((0, nodes), np.int16)
        self.split = np.zeros((0, nodes), np.uint8)
        self.value = np.zeros((0, leaves))
        if not len(y) or y.min() == y.max():
            return
        built = [self._tree(b, y, raw, p) for _ in range(p.trees)]
        self.feature, self.split, self.value = (np.stack(a) for a in zip(*built))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1).astype(np.uint8)

    def _tree(self, b: np.ndarray, y: np.ndarray, raw: np.ndarray, p: BoostParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        n_feat, node = b.shape[1], np.zeros(len(y), np.int64)  # node: place within the level
        feature, split = np.zeros((1 << p.depth) - 1, np.int16), np.full((1 << p.depth) - 1, 255, np.uint8)
        for level in range(p.depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-9)
            for j in range(n_feat):
                slot, shape = node * 256 + b[:, j], (width, 256)
                g, h, c = (np.bincount(slot, w, width * 256).reshape(shape).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + p.l2) + (gt - g) ** 2 / (ht - h + p.l2) - gt**2 / (ht + p.l2)
                gain = np.where((c >= p.least_leaf) & (ct - c >= p.least_leaf), gain, 0)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                split[first : first + width][better] = at[better]
            node = 2 * node + (b[np.arange(len(y)), feature[first + node]] > split[first + node])
        g, h = np.bincount(node, grad, 1 << p.depth), np.bincount(node, hess, 1 << p.depth)
        value = p.rate * g / (h + p.l2)
        raw += value[node]
        return feature, split, value

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        raw = np.full(len(x), self.base)
        for feature, split, value in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[at]] > split[at])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, label and the columns of `keep` of at most `size` learnable documents with a label, chosen by hash of doc_id.

    If a document has several labels the largest counts; if several rows have its id, the one of least text. The sample is
    bounded, hence the broadcast. Null ids have no label.
    """
    chosen = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(size)
    rows = docs.select("doc_id", F.struct("text", *keep).alias("_row")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "_label").agg(F.min("_row").alias("_row"))
    return one.select("doc_id", "_row.text", F.col("_label").cast("double").alias("label"), *(F.col(f"_row.`{c}`") for c in keep))


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, p: BoostParams = BoostParams()) -> BoostedTrees:
    """Fits on the measures of a bounded labelled sample; only they come to the driver. Without labels every score is the prior."""
    sample = labelled_sample(docs, labels, label, learnable, p.sample)
    # measured() drops all but doc_id and text: the label rides along in place of the id
    rows = measured(sample.select(F.col("label").cast("bigint").alias("doc_id"), "text")).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    x = features({k: rows[k].to_numpy() for k in MEASURES}) if len(rows) else np.zeros((0, 20))
    return BoostedTrees(x, rows["doc_id"].to_numpy(np.float64), p)


def scored(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, score of every row's whole text; null and empty texts are scored as texts without words.

    Repeated rows stay repeated and score alike; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes, independent of the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            parts = [features(measure(b)) for b in blocks(batch.column(1))]
            score = model.score(np.concatenate(parts)) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return id_and_bytes(docs).mapInArrow(run, "doc_id bigint, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, and has no label to learn from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    model = train(docs, labels, "quality", ~held_out)
    return scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
