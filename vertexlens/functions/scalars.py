"""Scalar and array functions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform


def exponential_decay(value: Column, t: Column, rate: float) -> Column:
    return value * F.exp(-F.lit(float(rate)) * t)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def date_text(at: Column, pattern: str = "yyyy-MM-dd_HH-mm-ss") -> Column:
    return F.date_format(at, pattern)


def current_date_text(pattern: str = "yyyy-MM-dd_HH-mm-ss") -> Column:
    return date_text(F.current_timestamp(), pattern)


def long_key(x: Column) -> Column:
    """A bigint as 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def max_pair(pairs: Column, field: str = "attr") -> Column:
    """The largest second member of an array of pairs, -1 for an empty one and as its floor."""
    return F.greatest(F.coalesce(F.array_max(F.transform(pairs, lambda p: p[field])), F.lit(-1)), F.lit(-1))


def random_element(items: Column, u: Column) -> Column:
    """An element of a (sorted) array by a uniform draw; null if empty."""
    return F.try_element_at(items, (F.floor(u * F.size(items)) + 1).cast("int"))


def random_subset(items: Column, k: int, seed: int) -> Column:
    """k elements (all, if fewer) with distinct places, in order of their draws; no draw repeats, so it always ends."""
    drawn = F.transform(items, lambda x, i: F.struct(uniform(seed, x, i).alias("u"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(drawn), 1, k), lambda p: p["x"])


def dice(common: Column, size_n: Column, size_q: Column) -> Column:
    """2 |N & Q| / (|Q| - 1 + |N|); null where that is 0 / 0."""
    return F.try_divide(2.0 * common, (size_q - 1 + size_n).cast("double"))


def append(path: Column, x: Column) -> Column:
    return F.concat(path, F.array(x))


def edit_distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Insertions and deletions cost 1, substitutions 2: len(a) + len(b) less twice the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            above = best[j]
            best[j] = diagonal + 1 if x == y else max(above, best[j - 1])
            diagonal = above
    return len(a) + len(b) - 2 * best[-1]


def _edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def edit_distance_of(a: str, b: str) -> Column:
    """edit_distance of two array columns, in Arrow batches."""
    return F.pandas_udf(_edit_distances, "int")(a, b)
