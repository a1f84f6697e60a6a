"""A Bloom filter as a table of set bits: it grows by union, merges by union, and is stored as Parquet."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform
from vertexlens.lineage import cut_lineage


@dataclass(frozen=True)
class BloomFilter:
    """bits(pos bigint), distinct; m bits, k hashes of kind `seed`. No false negatives."""

    bits: DataFrame
    m: int
    k: int
    seed: int = 42

    @staticmethod
    def positions(ids: DataFrame, m: int, k: int, seed: int) -> DataFrame:
        at = F.array(*(F.floor(uniform(seed, i, "id") * m).cast("bigint") for i in range(k)))
        return ids.select("id", F.explode(F.array_distinct(at)).alias("pos"))

    @staticmethod
    def build(ids: DataFrame, m: int, k: int, seed: int = 42) -> BloomFilter:
        """Repeated ids are hashed once: k rows are made for each id, not for each row."""
        ids = ids.select("id").distinct()
        return BloomFilter(BloomFilter.positions(ids, m, k, seed).select("pos").distinct(), m, k, seed)

    @staticmethod
    def sized(ids: DataFrame, rate: float, seed: int = 42) -> BloomFilter:
        """A filter whose bits and hashes give about `rate` false positives for the distinct ids."""
        ids = cut_lineage(ids.select("id").distinct())
        n = max(1, ids.count())
        return BloomFilter.build(ids, math.ceil(-n * math.log(rate) / math.log(2) ** 2), max(1, round(-math.log2(rate))), seed)

    def add(self, ids: DataFrame) -> BloomFilter:
        return self.merge(BloomFilter.build(ids, self.m, self.k, self.seed))

    def merge(self, other: BloomFilter) -> BloomFilter:
        if (self.m, self.k, self.seed) != (other.m, other.k, other.seed):
            raise ValueError("filters differ in size or hashes")
        return BloomFilter(self.bits.union(other.bits).distinct(), self.m, self.k, self.seed)

    def test(self, ids: DataFrame) -> DataFrame:
        """(id, might_contain) of each distinct id."""
        wanted = self.positions(ids.select("id").distinct(), self.m, self.k, self.seed)
        found = wanted.join(self.bits.withColumn("hit", F.lit(1)), "pos", "left")
        return found.groupBy("id").agg((F.count("hit") == F.count(F.lit(1))).alias("might_contain"))

    def save(self, path: str) -> None:
        self.bits.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, m: int, k: int, seed: int = 42) -> BloomFilter:
        return BloomFilter(spark.read.schema("pos bigint").parquet(path), m, k, seed)
