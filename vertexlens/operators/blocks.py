"""A graph's links as a matrix in blocks: a round moves arrays of numbers, not a row for each edge.

Every vertex lies in one of c shares, by hash, where it has a place in order of id. The edges from share i to share j are block i c + j:
they are dealt to it once, in packed portions, and then hold a few bytes each. In a round a block gets the numbers of its sources' share
and adds up what it sends to each of its targets; share j adds up what c blocks send. So c numbers of a vertex move each way, whatever
its edges. A task takes a block of about MOST_LINKS edges, in pieces of PIECE_LINKS at most, and a share has |V| / c numbers: c grows with
the square root of the edges. That pays where a vertex has many edges (`pays`). A row holds up to some 30 MB of numbers and goes to Python
in a batch of its own (`_a_row_at_a_time`), so neither side ever holds all rows of a share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.graph import Graph
from vertexlens.lineage import cut_and_observe, cut_lineage
from vertexlens.operators.triangles import place_of

#: Links of a block: a graph of few links has no more blocks than cores, one of many has more.
LEAST_LINKS, MOST_LINKS = 400_000, 2_000_000
#: Links that a dealing task holds, and those of a piece.
PORTION_LINKS, PIECE_LINKS = 500_000, 4_000_000
#: Numbers that may move each way for an edge; with more, rows move less.
MOST_NUMBERS = 8
#: Ids that a share holds before they are merged, and rows of a batch of scores.
HELD, BATCH = 1_000_000, 100_000
#: Bytes of an Arrow batch, beyond which it takes no further row.
BATCH_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]


def _ints(b: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b.as_buffer(), kind)


def _row(**columns) -> pa.RecordBatch:
    kinds = {bytes: pa.binary(), float: pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(type(v), pa.int32())) for v in columns.values()], list(columns))


def _rows(batches: Batches) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k] for name, column in zip(batch.schema.names, batch.columns)}


@contextmanager
def _a_row_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Jobs within send Python batches of BATCH_BYTES, or one longer row: by default a batch has 10,000 rows, so all of a task, on both sides."""
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def shares_for(links: int, cores: int) -> int:
    """c, such that c c blocks have MOST_LINKS links at most on average."""
    return max(1, math.ceil(math.sqrt(max(min(cores, -(-links // LEAST_LINKS)), -(-links // MOST_LINKS)))))


def pays(g: Graph) -> int | None:
    """c of a graph whose rounds move fewer numbers by blocks than rows by edges, else None; one with null ids goes by rows, too."""
    seen = [F.count(F.lit(1)), F.count_if(F.col("src").isNull() | F.col("dst").isNull()), F.approx_count_distinct("src") + F.approx_count_distinct("dst")]
    links, nulls, vertices = g.edges.agg(*seen).first()
    if not links or nulls:
        return None
    if not g.spanned:
        vertices, nulls = g.vertices.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    c = shares_for(links, g.edges.sparkSession.sparkContext.defaultParallelism)
    return c if not nulls and c * vertices <= MOST_NUMBERS * links else None


def _pieces(edges: DataFrame, c: int) -> DataFrame:
    """(block, heads, n, targets, to): a piece's sources, the links of each, its targets, and each link's place among them."""
    portion, most = PORTION_LINKS, PIECE_LINKS

    def dealt(batches: Batches) -> Batches:
        def of(held: list[tuple[np.ndarray, np.ndarray]]) -> Batches:
            src, dst = map(np.concatenate, zip(*held))
            block = (place_of(src, c) * c + place_of(dst, c)).astype(np.uint16 if c < 256 else np.int64)
            order = np.argsort(block, kind="stable")
            found, at = np.unique(block[order], return_index=True)
            src, dst = src[order], dst[order]
            for b, i, j in zip(found, at, [*at[1:], len(src)]):
                yield _row(block=int(b), src=src[i:j].tobytes(), dst=dst[i:j].tobytes())

        held, n = [], 0
        for batch in batches:
            held.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
            n += batch.num_rows
            if n >= portion:
                yield from of(held)
                held, n = [], 0
        if n:
            yield from of(held)

    def packed(batches: Batches) -> Batches:
        def piece(b: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            src, dst = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(src)
            src = src[order]
            dst = dst[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            heads, n = src[first].tobytes(), np.diff(first, append=len(src)).astype(np.int32).tobytes()
            del src, first
            order = np.argsort(dst)
            dst = dst[order]
            new = np.concatenate([[True], dst[1:] != dst[:-1]])
            targets = dst[new].tobytes()
            del dst
            to = np.empty(len(order), np.int32)
            to[order] = np.cumsum(new, dtype=np.int32) - 1
            return _row(block=b, heads=heads, n=n, targets=targets, to=to.tobytes())

        held: dict[int, list] = {}
        count: dict[int, int] = {}
        for r in _rows(batches):
            b = r["block"].as_py()
            held.setdefault(b, []).append((_ints(r["src"]), _ints(r["dst"])))
            count[b] = count.get(b, 0) + len(held[b][-1][0])
            if count[b] + portion > most:
                yield piece(b, held.pop(b))
                del count[b]
        while held:
            yield piece(*held.popitem())

    rows = edges.select("src", "dst").mapInArrow(dealt, "block int, src binary, dst binary").repartitionById(c * c, F.col("block"))
    return rows.mapInArrow(packed, "block int, heads binary, n binary, targets binary, to binary")


def _shares(pieces: DataFrame, vertices: DataFrame | None, c: int) -> DataFrame:
    """(share, ids, degrees): the vertices of a share in order, and the out-degree of each."""
    most = HELD

    def told(batches: Batches) -> Batches:
        for r in _rows(batches):
            i, j = divmod(r["block"].as_py(), c)
            yield _row(share=i, ids=r["heads"].as_py(), n=r["n"].as_py())
            yield _row(share=j, ids=r["targets"].as_py(), n=bytes(len(_ints(r["targets"])) * 4))

    def apart(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            share = place_of(ids, c)
            for k in np.unique(share):
                own = ids[share == k]
                yield _row(share=int(k), ids=own.tobytes(), n=bytes(len(own) * 4))

    def merged(batches: Batches) -> Batches:
        held: dict[int, list] = {}

        def merge(k: int) -> None:
            ids, at = np.unique(np.concatenate([x for x, _ in held[k]]), return_inverse=True)
            held[k] = [(ids, np.bincount(at, np.concatenate([n for _, n in held[k]]), len(ids)).astype(np.int64))]

        for r in _rows(batches):
            k = r["share"].as_py()
            held.setdefault(k, []).append((_ints(r["ids"]), _ints(r["n"], np.int32)))
            if sum(len(x) for x, _ in held[k][1:]) > max(most, len(held[k][0][0])):
                merge(k)
        for k in held:
            merge(k)
            yield _row(share=k, ids=held[k][0][0].tobytes(), degrees=held[k][0][1].tobytes())

    lists = pieces.select("block", "heads", "n", "targets").mapInArrow(told, "share int, ids binary, n binary")
    if vertices is not None:
        lists = lists.unionByName(vertices.select("id").mapInArrow(apart, "share int, ids binary, n binary"))
    return cut_lineage(lists.repartitionById(c, F.col("share")).mapInArrow(merged, "share int, ids binary, degrees binary"))


def _to_blocks(rows: DataFrame, c: int, sources: bool, *columns: Column) -> DataFrame:
    """(block, columns) of a share's row for each of the c blocks whose sources, or else targets, are the share's."""
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("x"))
    return every.select((F.col("share") * c + F.col("x") if sources else F.col("x") * c + F.col("share")).alias("block"), *columns)


@dataclass(frozen=True)
class Blocks:
    """rows(block, to_share, size, heads, n, degrees, at, to) cached, by block; shares(share, ids, degrees) written."""

    rows: DataFrame
    shares: DataFrame
    c: int
    parts: int

    @staticmethod
    def of(g: Graph, c: int) -> Blocks:
        pieces = _pieces(g.edges, c).persist()
        shares = _shares(pieces, None if g.spanned else g.vertices, c)
        parts = 2 * c * c

        def placed(batches: Batches) -> Batches:
            for r in _rows(batches):
                ids, b = _ints(r["target_ids"]), r["block"].as_py()
                heads = np.searchsorted(_ints(r["source_ids"]), _ints(r["heads"])).astype(np.int32)
                at = np.searchsorted(ids, _ints(r["targets"])).astype(np.int32)
                degrees = _ints(r["degrees"])[heads].astype(np.float64)
                yield _row(block=b, to_share=b % c, size=len(ids), heads=heads.tobytes(), n=r["n"].as_py(), degrees=degrees.tobytes(), at=at.tobytes(), to=r["to"].as_py())

        sources = _to_blocks(shares, c, True, F.col("ids").alias("source_ids"), F.col("degrees"))
        targets = _to_blocks(shares, c, False, F.col("ids").alias("target_ids"))
        rows = pieces.join(sources, "block").join(targets, "block").mapInArrow(placed, "block int, to_share int, size int, heads binary, n binary, degrees binary, at binary, to binary")
        rows = rows.repartition(parts, "block").sortWithinPartitions("block").persist()
        rows.count()
        pieces.unpersist()
        return Blocks(rows, shares, c, parts)

    def filled(self, value: float) -> DataFrame:
        """(share, numbers): the value for every vertex."""

        def run(batches: Batches) -> Batches:
            for r in _rows(batches):
                yield _row(share=r["share"].as_py(), numbers=np.full(len(_ints(r["ids"])), value).tobytes())

        return self.shares.select("share", "ids").mapInArrow(run, "share int, numbers binary")

    def spread(self, state: DataFrame, reset: float, old: DataFrame | None = None) -> DataFrame:
        """(share, numbers, moved): reset plus 1 - reset of what the sources of a vertex's links share out evenly; `moved`, the largest change from `old`, if given."""

        def send(batches: Batches) -> Batches:
            for r in _rows(batches):
                each = _ints(r["numbers"], np.float64)[_ints(r["heads"], np.int32)] / _ints(r["degrees"], np.float64)
                at = r["at"].as_py()
                sums = np.bincount(_ints(r["to"], np.int32), np.repeat(each, _ints(r["n"], np.int32)), len(at) // 4)
                yield _row(share=r["to_share"].as_py(), size=r["size"].as_py(), at=at, numbers=sums.tobytes())

        def add(batches: Batches) -> Batches:
            sums: dict[int, np.ndarray] = {}
            before: dict[int, np.ndarray] = {}
            for r in _rows(batches):
                k = r["share"].as_py()
                own = sums.setdefault(k, np.zeros(r["size"].as_py()))
                if r["at"].is_valid:
                    own[_ints(r["at"], np.int32)] += _ints(r["numbers"], np.float64)
                elif r["numbers"].is_valid:
                    before[k] = _ints(r["numbers"], np.float64)
            for k, own in sums.items():
                new = reset + (1 - reset) * own
                yield _row(share=k, numbers=new.tobytes(), moved=float(np.abs(new - before[k]).max()) if k in before else 0.0)

        sent = _to_blocks(state, self.c, True, F.col("numbers")).repartition(self.parts, "block")
        mail = self.rows.join(sent, "block").drop("block").mapInArrow(send, "share int, size int, at binary, numbers binary")
        values = self.shares.select("share", F.length("ids").alias("bytes"), F.lit(None).cast("binary").alias("numbers"))
        if old is not None:
            values = old.select("share", F.length("numbers").alias("bytes"), "numbers")
        values = values.select("share", (F.col("bytes") / 8).cast("int").alias("size"), F.lit(None).cast("binary").alias("at"), "numbers")
        return mail.unionByName(values).repartitionById(self.c, F.col("share")).mapInArrow(add, "share int, numbers binary, moved double")

    def scores(self, state: DataFrame) -> DataFrame:
        """(id, score) of every vertex."""

        def run(batches: Batches) -> Batches:
            for r in _rows(batches):
                ids, numbers = _ints(r["ids"]), _ints(r["numbers"], np.float64)
                for i in range(0, len(ids), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + BATCH]), pa.array(numbers[i : i + BATCH])], ["id", "score"])

        return self.shares.select("share", "ids").join(state.select("share", "numbers"), "share").mapInArrow(run, "id bigint, score double")

    def unpersist(self) -> None:
        self.rows.unpersist()


def ranks(g: Graph, c: int, iterations: int, reset: float, init: float, cut_every: int) -> DataFrame:
    """(id, score) after a fixed number of rounds; `cut_every` rounds are one plan."""
    with _a_row_at_a_time(g.edges.sparkSession):
        blocks = Blocks.of(g, c)
        state = blocks.filled(float(init))
        for i in range(iterations):
            state = blocks.spread(state, reset)
            if (i + 1) % cut_every == 0 or i + 1 == iterations:
                state = cut_lineage(state)
        blocks.unpersist()
        return cut_lineage(blocks.scores(state))


def ranks_until(g: Graph, c: int, tolerance: float, reset: float, init: float, most: int) -> DataFrame:
    """(id, score) once no score moves by more than tolerance, which the job that writes a round tells."""
    with _a_row_at_a_time(g.edges.sparkSession):
        blocks = Blocks.of(g, c)
        state = cut_lineage(blocks.filled(float(init)))
        for _ in range(most):
            state, seen = cut_and_observe(blocks.spread(state, reset, old=state), moved=F.max("moved"))
            if seen["moved"] is None or seen["moved"] <= tolerance:
                break
        blocks.unpersist()
        return cut_lineage(blocks.scores(state))
