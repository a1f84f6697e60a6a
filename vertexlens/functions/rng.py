"""Hash-derived randomness: the same draw for the same key, whatever the partitions, retries or engine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 4503599627370496.0  # 16^13


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """Uniform on [0, 1) from md5 of seed and keys, joined by colons."""
    parts = [F.lit(str(seed)), *((F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string")) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same draw as DuckDB SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::bigint / {_SCALE:.1f})"


def uniform_value(seed: int, *keys) -> float:
    """The same draw on the driver or in a worker."""
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16) / _SCALE


def geometric(u: Column, p: float) -> Column:
    """Trials up to the first success of probability p, by the inverse distribution: at least 1, mean 1/p."""
    return (F.floor(F.log(F.greatest(u, F.lit(1e-300))) / math.log(1 - p)) + 1).cast("bigint")


def geometric_continue(u: Column, go_on: float) -> Column:
    """1 + the number of continuations of probability go_on: mean 1/(1 - go_on)."""
    return geometric(u, 1 - go_on)


def geometric_value(u: float, p: float) -> int:
    return math.floor(math.log(max(u, 1e-300)) / math.log(1 - p)) + 1
