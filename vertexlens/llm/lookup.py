"""Joins to a table of values with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlens.llm.frames import BROADCAST_BYTES

#: A key with over 1/HEAVY of all uses is heavy, so there are at most HEAVY heavy keys, whatever the size of the tables.
HEAVY = 1 << 18
#: Bytes of a key beyond which it is left to the shuffle, so that what is broadcast of heavy keys is bounded.
KEY_BYTES = 64


def with_values(rows: DataFrame, values: DataFrame, key: str, uses: str = "uses", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined to values(key, uses, ...), which is materialised; uses tells how often a key occurs in rows. No order of columns is promised.

    values of up to broadcast_bytes, keys counted by their bytes, go to all executors. Of larger ones only the heavy keys do
    (HEAVY rows of at most KEY_BYTES at most); the rest is joined by a shuffle in which no key has over 1/HEAVY of the
    rows, but for keys over KEY_BYTES, which Spark's skew join splits. rows is then read twice.
    """
    n, size, total = values.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)), F.coalesce(F.sum(uses), F.lit(0))).first()
    if size + 48 * n <= broadcast_bytes:
        return rows.join(F.broadcast(values.drop(uses)), key)
    heavy = (F.col(uses) > total // HEAVY) & (F.octet_length(key) <= KEY_BYTES)
    common = values.where(heavy).drop(uses)
    near = rows.join(F.broadcast(common), key)
    far = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(values.where(~heavy).drop(uses).hint("shuffle_merge"), key)
    return near.unionByName(far)


def floor_div(a: Column, b: Column) -> Column:
    """a / b as whole number, rounded down, of longs up to 2^53 times b."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")
