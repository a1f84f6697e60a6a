"""Small DataFrame helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.lineage import cut_lineage

__all__ = ["bounded_batches", "broadcast_if_small", "crc_mod", "cut_lineage", "id_and_bytes", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a side of a join may take to be broadcast, at 48 bytes a row of a few numbers.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """df, which is materialised and narrow, to be broadcast if its counted rows are within BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes else df


def _bytes(size: str) -> int:
    return int(size[:-1]) << {"k": 10, "m": 20, "g": 30}[size[-1]] if size[-1] in "kmg" else int(size)


def bounded_batches(df: DataFrame, records: int = 2000, size: str = "16m") -> DataFrame:
    """Lets Arrow batches of whole texts hold at most so many records and bytes, as texts can be very long.

    Two settings of the session are lowered, and stay so, since a plan reads them when it runs; lower ones are left alone.
    """
    conf = df.sparkSession.conf
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(records)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(name).lower().removesuffix("b")
        if not 0 < _bytes(now) <= _bytes(bound):
            conf.set(name, bound)
    return df


def id_and_bytes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the whole text as UTF-8 bytes, null as empty, and the columns of `keep`; all other columns are pruned."""
    return bounded_batches(docs).select("doc_id", F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("body"), *keep)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)
