"""Target-distribution importance resampling by hashed n-gram features, with a dictionary of distinct features.

Feature strings are counted over all documents and over the target; each distinct string is hashed to its bucket once, the
buckets' counts give gains, and the gains are joined back to the documents' feature counts. A document's weight is the
mean gain of its features; with Gumbel noise from its id, the highest scores are a sample in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlens.llm.frames import cut_lineage, id_and_bytes, table
from vertexlens.llm.lookup import floor_div, with_values
from vertexlens.llm.neardup import row_keys
from vertexlens.llm.textbytes import LOWER, Block, blocks, byte_table, owner, runs

#: Words, A-Z lower-cased: runs of digits, a-z and all that is not ASCII.
_WORD = byte_table(range(48, 58), bytes(range(97, 123)), bytes(range(128, 256)))
#: Copies of one row (id and text) that a task writes out.
_COPIES = 100_000


@dataclass(frozen=True)
class ResampleParams:
    """Features are runs of 1 to `order` words, in `buckets` buckets; `percent` of the documents with `least_words` words are drawn."""

    order: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024

    def features(self, words: int) -> int:
        """The number of features of so many words; it grows with them."""
        return sum(max(0, words - m) for m in range(self.order))


def block_features(b: Block, order: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, feature, count) of each distinct feature of each text of the block."""
    low = LOWER[b.buf]
    inside = _WORD[low]
    start, end = runs(inside)
    doc = owner(b, start)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside].tobytes())])
    texts, found, counts = [], [], []
    for m in range(1, order + 1):
        n = max(0, len(words) - m + 1)
        same = doc[:n] == doc[m - 1 :]
        runs_of = words if m == 1 else pc.binary_join_element_wise(*(words[i : i + n] for i in range(m)), " ").filter(pa.array(same))
        coded = runs_of.dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, count = np.unique(doc[:n][same] * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        texts.append(key // size)
        found.append(coded.dictionary.take(pa.array(key % size)))
        counts.append(count)
    return np.concatenate(texts), pa.concat_arrays(found), np.concatenate(counts)


def feature_counts(docs: DataFrame, p: ResampleParams) -> DataFrame:
    """(k1, k2, feature, n): how often each distinct feature occurs in each row of docs(doc_id, text), told apart by row_keys."""
    texts = id_and_bytes(docs.select("doc_id", "text", *row_keys()), keep=("k1", "k2")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                text, feature, n = block_features(b, p.order)
                at = pa.array(text + b.first)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), feature, pa.array(n, pa.int64())], ["k1", "k2", "feature", "n"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, feature string, n bigint")


def dictionary(features: DataFrame, target: DataFrame, p: ResampleParams) -> DataFrame:
    """(feature, bucket, s, t, uses) of every distinct feature: its counts in both, its bucket, and the documents that have it."""
    zero = F.lit(0).cast("bigint")
    both = features.select("feature", F.col("n").alias("s"), zero.alias("t"), F.lit(1).alias("uses")).unionByName(target.select("feature", zero.alias("s"), F.col("n").alias("t"), F.lit(0).alias("uses")))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("uses").alias("uses"))
    return counted.select("feature", (F.crc32(F.col("feature").cast("binary")) % p.buckets).alias("bucket"), "s", "t", "uses")


def bucket_gains(features: DataFrame, p: ResampleParams) -> DataFrame:
    """(bucket, gain) of the buckets of dictionary(): at most `buckets` rows."""
    b = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = Window.partitionBy()
    as_double = lambda c: c.cast("double")
    b = b.select("bucket", as_double(F.col("s") + 1).alias("s1"), as_double(F.col("t") + 1).alias("t1"), as_double(F.sum("s").over(every) + p.buckets).alias("S"), as_double(F.sum("t").over(every) + p.buckets).alias("T"))
    return b.select("bucket", F.floor(F.lit(1000.0) * F.log(F.col("t1") * F.col("S") / (F.col("s1") * F.col("T")))).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """(k1, k2, doc_id, copies, n_features, weight) of each distinct row (id and text) of docs; the weight is the floored mean gain, 0 without features."""
    features = feature_counts(docs, p)
    known = cut_lineage(dictionary(features, feature_counts(target, p), p))
    gains = cut_lineage(known.where("uses > 0").join(F.broadcast(bucket_gains(known, p)), "bucket").select("feature", "uses", "gain"))
    sums = with_values(features, gains, "feature").select("k1", "k2", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("copies"), "n", (F.col("n") * F.col("gain")).alias("gain"))
    none = F.lit(0).cast("bigint")
    own = docs.select(*row_keys(), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(1).alias("copies"), none.alias("n"), none.alias("gain"))
    met = own.unionByName(sums).groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    # equal rows had their features counted together
    weight = F.when(F.col("n") > 0, floor_div(F.col("gain"), F.col("n"))).otherwise(none)
    return met.select("k1", "k2", "doc_id", "copies", floor_div(F.col("n"), F.col("copies")).alias("n_features"), weight.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs(doc_id, text): rank from 1 of the drawn ones, else null.

    Drawn are the floor(percent * N / 100) highest scores of the N rows with least_words words, ties to the smaller
    doc_id, null last. A null or empty text has no features and weight 0; a null doc_id draws its noise from an empty id.
    Repeated rows stay repeated: equal ones have equal scores and ranks in a row. Rows of an id but of different texts
    that tie are in an arbitrary but fixed order. Without target the gains are what empty counts give; an empty table gives no rows.
    Other columns are ignored.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weights(docs, target, p).withColumn("score", F.col("weight") + noise))
    able = F.col("n_features") >= p.features(p.least_words)
    most = (scored.where(able).agg(F.sum("copies")).first()[0] or 0) * p.percent // 100
    # scores are whole numbers in a range that logarithms bound
    levels = scored.where(able).groupBy("score").agg(F.sum("copies").alias("c"))
    levels = levels.select("score", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    placed = scored.withColumn("level", F.when(able, F.col("score"))).join(F.broadcast(levels.where(F.col("above") < most).withColumnRenamed("score", "level")), "level", "left")
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    drawn = placed.where("above is not null").withColumn("first", F.col("above") + F.coalesce(F.sum("copies").over(among), F.lit(0)))
    rows = drawn.unionByName(placed.where("above is null").withColumn("first", F.lit(None).cast("bigint")))
    few = rows.where(F.col("copies") <= _COPIES).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    parts = rows.where(F.col("copies") > _COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), floor_div(F.col("copies") - 1, F.lit(_COPIES))))).repartition("k1", "part")
    many = parts.withColumn("i", F.explode(F.sequence(F.col("part") * _COPIES + 1, F.least("copies", (F.col("part") + 1) * _COPIES)))).drop("part")
    place = F.col("first") + F.col("i")
    return few.unionByName(many).select("doc_id", "n_features", "weight", "score", F.when(place <= most, place).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return resample(table(spark, sf_dir, "documents"), target)


_STEP = lambda c: f"(xor({c} >> 1, 3988292384 * ({c} & 1)))"
_CRC_TABLE = ", ".join([f"c{i + 1} as (select i, {_STEP('c')} as c from c{i})" for i in range(8)])
#: crc32 by its table of 256 remainders, one list_reduce a word.
OP13_SQL = f"""
with c0 as (select i, i as c from (select unnest(range(256)) as i)), {_CRC_TABLE},
crc as materialized (select list(c order by i) as crc from c8),
d as (select 'd' as kind, doc_id, text from documents union all select 'b', item_id, text from benchmark),
w as materialized (select kind, row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from d),
f as (select kind, r, unnest(ws) as feature from w),
u as (select feature, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from f group by feature),
x as (select feature, s, t, hex(encode(feature)) as h from u),
y as (select feature, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket from x, crc),
g as (select bucket, floor(1000 * ln((sum(t) + 1)::double * ((sum(sum(s)) over ()) + 10000)::double / ((sum(s) + 1)::double * ((sum(sum(t)) over ()) + 10000)::double)))::bigint as gain from y group by bucket),
m as (select r, count(*) as n, sum(gain) as gain from f join y using (feature) join g using (bucket) where kind = 'd' group by r),
z as (select w.r, doc_id, coalesce(n, 0) as n_features, coalesce(floor(gain / n::double)::bigint, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from w left join m using (r) where kind = 'd'),
s as (select r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from z),
k as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from s where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from s left join k using (r)
"""
