"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken longest first. A piece goes to the open bin that it leaves fullest; if none has room, the length is
opened whose final cost per token is least when the pieces still to come fill it, longest first. At the end every bin is
downsized to the shortest permitted length that holds its contents. Opening the shortest length that holds the piece is
tried beside it, and each shard keeps the cheaper packing of the two: where small pieces abound, that is the shortest.

Documents are dealt to shards by hash, as many as the corpus needs, and each shard is packed alone: a shard's size is
bounded, and only a few bins per shard are left part empty. Equal rows are counted first and dealt evenly over all shards.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import table


@dataclass(frozen=True)
class PackParams:
    """lengths: permitted sequence lengths, ascending. A bin of length n costs n * (1 + n / attention).

    discount: in pack() without an opening rule, the share of its proportional cost that room left in a new bin is thought
    to be worth; up to 1 that opens the shortest length that holds the piece.
    shard_rows: about how many documents are packed together.
    """

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    attention: float = 32768.0
    discount: float = 0.85
    shard_rows: int = 4000

    def cost(self, n: int) -> float:
        return n * (1 + n / self.attention)


def pieces(length: int, longest: int) -> list[int]:
    """A document longer than the longest length is cut into full pieces and a rest: nothing is dropped."""
    whole, rest = divmod(length, longest)
    return [longest] * whole + ([rest] if rest else [])


def look_ahead(sizes: list[int], p: PackParams) -> Callable[[int], int]:
    """The length to open for the piece at a place of `sizes`, from the final cost per token after filling it with those behind it."""
    neg = [-s for s in sizes]

    def opening(at: int) -> int:
        found = []
        for n in p.lengths:
            if n < sizes[at]:
                continue
            free, i = n - sizes[at], at + 1
            while (i := bisect.bisect_left(neg, -free, i)) < len(neg):
                end = bisect.bisect_right(neg, neg[i], i)  # pieces of one size at a time
                free -= min(end - i, free // sizes[i]) * sizes[i]
                i = end
            final = next(m for m in p.lengths if m >= n - free)
            found.append((p.cost(final) / (n - free), n))
        return min(found)[1]

    return opening


def cheapest(sizes: list[int], p: PackParams) -> tuple[list[int], list[int], list[int]]:
    """pack() by look_ahead() or by the shortest length that holds a piece, whichever costs less."""
    return min(pack(sizes, p), pack(sizes, p, look_ahead(sizes, p)), key=lambda x: sum(map(p.cost, x[2])))


def pack(sizes: list[int], p: PackParams, opening: Callable[[int], int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece and the final length of each bin, for pieces in descending order of size.

    opening: the length of the bin that the piece at a place opens.
    """
    room: list[tuple[int, int]] = []  # (free, -bin) ascending: the best fit is the first with free >= size, the oldest bin of equals
    capacity: list[int] = []
    used: list[int] = []
    place, offset = [], []
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(room, (s, -len(capacity)))
        if at < len(room):
            free, b = room.pop(at)
            b = -b
        else:
            fits = [n for n in p.lengths if n >= s]
            n = opening(i) if opening else min(fits, key=lambda n: (p.cost(n) - p.discount * p.cost(n) * (n - s) / n, n))
            b, free = len(capacity), n
            capacity.append(n)
            used.append(0)
        place.append(b)
        offset.append(used[b])
        used[b] += s
        if free > s:
            bisect.insort(room, (free - s, -b))
    return place, offset, [next(n for n in p.lengths if n >= u) for u in used]


def packed(lengths: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, n_tokens, shard, bin, bin_offset, bin_length: one row per piece, from rows (doc_id, n_tokens).

    Null, zero and negative lengths take no room: one row with n_tokens 0 and bin, bin_offset, bin_length null. Repeated
    rows are packed once each, as many in one shard as in another, so a row (or a null id) that makes up much of the table
    is no task's burden; ties go by doc_id, then piece. An empty table gives no rows; other columns are ignored. The
    result does not depend on partitions.
    """
    rows = lengths.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    shards = max(1, -(-rows.count() // p.shard_rows))
    equal = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    equal = equal.withColumn("at", F.explode(F.sequence(F.lit(0), F.least("c", F.lit(shards)) - 1)))
    share = F.expr(f"c div {shards}") + F.when(F.col("at") < F.col("c") % shards, 1).otherwise(0)
    dealt = equal.select("doc_id", "n_tokens", share.alias("c"), F.pmod(F.xxhash64("doc_id", "n_tokens") % shards + F.col("at"), F.lit(shards)).alias("shard"))
    names = ["doc_id", "piece", "n_tokens", "shard", "bin", "bin_offset", "bin_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            cut = [(-n, d is not None, d or 0, k) for d, size in held for k, n in enumerate(pieces(size, p.lengths[-1]))]
            cut.sort()
            place, offset, final = cheapest([-n for n, *_ in cut], p)
            out = [(d if known else None, k, -n, now, b, o, final[b]) for (n, known, d, k), b, o in zip(cut, place, offset)]
            out += [(d, 0, 0, now, None, None, None) for d, size in held if not size]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        for batch in batches:
            for s, d, n, c in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "c"))):
                if s != now and held:
                    yield done()
                    held = []
                now = s
                held += [(d, n)] * c
        if held:
            yield done()

    ordered = dealt.repartition("shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: words outside [\\x20\\x09-\\x0D] and one end mark; a text without words has 0."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.when(words > 0, words + 1).otherwise(0).cast("bigint").alias("n_tokens"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(word_lengths(table(spark, sf_dir, "documents")))
