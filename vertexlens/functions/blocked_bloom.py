"""A Bloom filter of 32-byte blocks: an id's bits lie in one block, so building and testing look at one row an id.

A row is a block, its 256 bits as eight numbers of 32; building is an OR aggregation that combines before it shuffles, so no
row a bit is ever made. Small filters go to the executors whole; larger ones are joined by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform

#: Words of a block, and bits of a word; an id sets one bit of each word.
WORDS, BITS = 8, 32
#: Bytes of a filter that is broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class BlockedBloom:
    """rows(block bigint, w0 .. w7 bigint) of the blocks that have bits; `blocks` of them in all. No false negatives."""

    rows: DataFrame
    blocks: int
    seed: int = 42

    @staticmethod
    def blocks_for(n: int, rate: float) -> int:
        """Blocks for n ids: 8 bits an id make about `rate` false positives, a fifth more for the uneven load of blocks."""
        bits = -WORDS / math.log(1 - rate ** (1 / WORDS)) * 1.2
        return max(1, math.ceil(n * bits / (WORDS * BITS)))

    @staticmethod
    def _hashed(rows: DataFrame, column: str, blocks: int, seed: int) -> DataFrame:
        """rows with _block and _w0 .. _w7: in each word the one bit that the id sets, by five bits of a hash of its own."""
        draw = F.xxhash64(column, F.lit(seed))
        bit = lambda k: F.shiftright(draw, 5 * k).bitwiseAND(F.lit(BITS - 1)).cast("int")
        words = {f"_w{k}": F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(k)) for k in range(WORDS)}
        return rows.withColumns({"_block": F.floor(uniform(seed, F.lit("block"), column) * blocks).cast("bigint")} | words)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))

    @staticmethod
    def build(ids: DataFrame, blocks: int, seed: int = 42) -> BlockedBloom:
        hashed = BlockedBloom._hashed(ids.select("id").where("id is not null"), "id", blocks, seed)
        return BlockedBloom(BlockedBloom._merged(hashed.select(F.col("_block").alias("block"), *(F.col(f"_w{k}").alias(f"w{k}") for k in range(WORDS)))), blocks, seed)

    @staticmethod
    def sized(ids: DataFrame, rate: float, seed: int = 42) -> BlockedBloom:
        """A filter for about `rate` false positives; repeated ids are counted about once."""
        n = ids.agg(F.approx_count_distinct("id")).first()[0]
        return BlockedBloom.build(ids, BlockedBloom.blocks_for(n, rate), seed)

    @property
    def bytes(self) -> int:
        return self.blocks * WORDS * (BITS // 8)

    @property
    def is_small(self) -> bool:
        """Whether it is broadcast: a row takes about three times the bytes of its bits."""
        return 3 * self.bytes <= BROADCAST_BYTES

    def add(self, ids: DataFrame) -> BlockedBloom:
        return self.merge(BlockedBloom.build(ids, self.blocks, self.seed))

    def merge(self, other: BlockedBloom) -> BlockedBloom:
        if (self.blocks, self.seed) != (other.blocks, other.seed):
            raise ValueError("filters differ in size or hashes")
        return BlockedBloom(self._merged(self.rows.unionByName(other.rows)), self.blocks, self.seed)

    def _told(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with _hit: whether the column's value might be in the filter; one block is met a row."""
        theirs = self.rows.select(F.col("block").alias("_block"), *(F.col(f"w{k}").alias(f"_b{k}") for k in range(WORDS)))
        met = self._hashed(rows, column, self.blocks, self.seed).join(F.broadcast(theirs) if self.is_small else theirs, "_block", "left")
        hit = reduce(Column.__and__, (F.col(f"_b{k}").bitwiseAND(F.col(f"_w{k}")) != 0 for k in range(WORDS)))
        return met.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(column).isNotNull() & F.coalesce(hit, F.lit(False))).alias("_hit"))

    def test(self, ids: DataFrame) -> DataFrame:
        """(id, might_contain) of each distinct id; null is in no filter."""
        return self._told(ids.select("id").distinct(), "id").select("id", F.col("_hit").alias("might_contain"))

    def keep(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows whose columns all might be in the filter, before joins that tell for sure."""
        for c in columns:
            rows = self._told(rows, c).where("_hit").drop("_hit")
        return rows

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, blocks: int, seed: int = 42) -> BlockedBloom:
        return BlockedBloom(spark.read.schema("block bigint, " + ", ".join(f"w{k} bigint" for k in range(WORDS))).parquet(path), blocks, seed)
