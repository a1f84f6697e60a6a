"""Triangle counts by colour triples: no wedge is ever written, sorted or shuffled.

Every vertex has one of c colours, by hash. The edges between two colours are a class: they are dealt to it once, and packed
into a few bytes each. A class then goes to each of the c triples of colours that hold both of its own, so a triangle
lies whole in the triple of its vertices' colours, and in no other one is it counted. A task takes a triple of no more than
TASK_EDGES edges, whatever the size of the graph: c grows with the square root of the edges, and what is shuffled is
c packed copies of them, which is |E|^1.5, as are the wedges that the tasks look at in memory. Up to FEW_COLOURS, where
copies are few, a triple is smaller still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlens.graph import Direction, Graph
from vertexlens.lineage import cut_lineage

#: Edges of a triple, and of a graph that is no more than one.
TASK_EDGES, ONE_TASK = 6_000_000, 200_000
#: Edges of a triple with so many copies of the edges at most.
FEW_EDGES, FEW_COLOURS = 1_000_000, 9
#: Edges that a dealing task holds, wedges looked at in one go, possible triangles checked in one go, and slots of a table of hashes.
TASK_LINKS, WEDGES, CHECKED, SLOTS = 500_000, 1_000_000, 1_000_000, 1 << 22
#: Dealing tasks' edges for each place that counts are summed up in.
PLACE_TASKS = 4
#: Edges that are met with the neighbours of their second end in one go, and places of a table of ids for each edge.
PORTION, TABLE_SPAN = 1_000_000, 8
#: A vertex with more edges, repeated ones included, may call for more colours.
HUB_LINKS = 1_000_000

Arrays = tuple[np.ndarray, ...]


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte, compressed; small differences take few bytes."""
    planes = []
    for c in columns:
        d = np.diff(c.astype(np.int64), prepend=0)
        planes.append(((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes())
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def unpack(blob: bytes, columns: int) -> Arrays:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * 8 * columns, asbytes=True), np.uint8).reshape(columns, 8, n)
    out = []
    for p in planes:
        z = np.array(p.T, order="C").view(np.int64).reshape(-1)
        odd = -(z & 1)
        z = z.view(np.uint64)
        z >>= np.uint64(1)
        z = z.view(np.int64)
        z ^= odd
        out.append(np.cumsum(z, out=z))
    return tuple(out)


def in_order(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> Arrays:
    """The columns in order of (a, b), of equal pairs one; pairs that fit are sorted as single numbers."""
    if not len(a):
        return a, b, *more
    low = min(int(a.min()), int(b.min()))
    span = max(int(a.max()), int(b.max())) - low + 1
    if span < 3_000_000_000:
        key = (a - low) * span + (b - low)
        if not more:
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            x = key // span
            return x + low, key - x * span + low
        order = np.argsort(key)
    else:
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new], *(c[order][new] for c in more)


def place_of(ids: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1 by hash."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _dealt(columns: Arrays, places: int, ordered: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (place, blob) of the columns, dealt by the first, in order of the first and second, without repeats."""
    columns = columns if ordered else in_order(*columns)
    place = place_of(columns[0], places)
    order = np.argsort(place.astype(np.uint16) if places < 1 << 16 else place, kind="stable")
    place, columns = place[order], tuple(c[order] for c in columns)
    found, at = np.unique(place, return_index=True)
    if len(found):
        blobs = [pack(*(c[i:j] for c in columns)) for i, j in zip(at, [*at[1:], len(place)])]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["place", "blob"])


def _joined(batches: Iterator[pa.RecordBatch], columns: int) -> Arrays:
    parts = [unpack(x.as_buffer().to_pybytes(), columns) for b in batches for x in b.column(b.schema.get_field_index("blob"))]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(columns))


def _merged(a: np.ndarray, b: np.ndarray, ways: np.ndarray | None) -> Arrays:
    """The pairs in order, each once, with the union of its ways (bit 0: from a to b, bit 1: from b to a), if they count."""
    if ways is None:
        return in_order(a, b)
    order = np.lexsort((b, a))
    a, b, ways = a[order], b[order], ways[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.bitwise_or.reduceat(ways, at) if len(at) else ways


def largest_degree(edges: DataFrame, n_edges: int) -> int:
    """The most edges that a vertex has, repeated ones included; 0 if it is under HUB_LINKS.

    A task tells of the vertices that have half that share of its own ends, so what it does not tell of a hub is less than half.
    """
    if n_edges <= HUB_LINKS:
        return 0
    share, most = HUB_LINKS / (4 * n_edges), TASK_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for a, b in _portions(batches, most):
            u, m = np.unique(np.concatenate([a, b]), return_counts=True)
            total += 2 * len(a)
            ids, at = np.unique(np.concatenate([ids, u]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(ids)).astype(np.int64)
        heavy = n >= max(2, share * total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[heavy]), pa.array(n[heavy])], ["id", "n"])

    told = edges.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return 2 * told if told >= HUB_LINKS / 2 else 0


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Arrays]:
    """(src, dst) of the edges between two vertices, in portions of about `most`."""
    held, n = [], 0
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        real = a != b
        held.append((a[real], b[real]))
        n += len(held[-1][0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def colours_for(n_edges: int, most_degree: int) -> int:
    """So many that three classes have TASK_EDGES edges, or FEW_EDGES with up to FEW_COLOURS, and a hub's edges to one colour no more than a third of TASK_EDGES."""
    if n_edges <= ONE_TASK:
        return 1
    few = min(FEW_COLOURS, math.ceil(math.sqrt(6 * n_edges / FEW_EDGES)))
    return max(3, few, math.ceil(math.sqrt(6 * n_edges / TASK_EDGES)), math.ceil(3 * most_degree / TASK_EDGES))


def classes(edges: DataFrame, c: int, directed: bool) -> DataFrame:
    """(x, y, blob) of each class: colours x <= y and its distinct edges (a, b and, if directed, the ways), a < b, checkpointed. Edges move once."""
    columns, most = 3 if directed else 2, TASK_LINKS

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, dst in _portions(batches, most):
            found = _merged(np.minimum(src, dst), np.maximum(src, dst), np.where(src < dst, 1, 2) if directed else None)
            one, two = place_of(found[0], c), place_of(found[1], c)
            high = np.maximum(one, two)
            number = high * (high + 1) // 2 + np.minimum(one, two)
            order = np.argsort(number.astype(np.uint16) if c < 256 else number, kind="stable")
            number, found = number[order], tuple(x[order] for x in found)
            of, at = np.unique(number, return_index=True)
            blobs = [pack(*(x[i:j] for x in found)) for i, j in zip(at, [*at[1:], len(number)])]
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(blobs, pa.binary())], ["place", "blob"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, *ways = _joined(batches, columns)
        if len(a):
            colours = sorted(int(place_of(x[:1], c)[0]) for x in (a, b))
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in colours), pa.array([pack(*_merged(a, b, ways[0] if ways else None))], pa.binary())], ["x", "y", "blob"])

    rows = edges.select("src", "dst").mapInArrow(dealt, "place bigint, blob binary").repartitionById(c * (c + 1) // 2, F.col("place").cast("int"))
    return cut_lineage(rows.mapInArrow(merged, "x int, y int, blob binary"))


#: For the corners of a triangle u, v, w of ascending rank: the bits of its edges u-v, u-w and v-w that must be set, so that
#: both others are in the corner's neighbour set; bit 0 is an edge to the higher rank.
_CORNERS = {"out": ((1, 1, 0), (2, 0, 1), (0, 2, 2)), "in": ((2, 2, 0), (1, 0, 2), (0, 1, 1))}


def numbered(parts: list[Arrays]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids ascending, a, b) of edges (a, b) in parts, whose ends become places in ids; ids close together are told by a table, others by search."""
    low = min(int(x.min()) for p in parts for x in p[:2])
    span = max(int(x.max()) for p in parts for x in p[:2]) - low + 1
    if span <= TABLE_SPAN * sum(len(p[0]) for p in parts):
        met = np.zeros(span, bool)
        for p in parts:
            met[p[0] - low] = met[p[1] - low] = True
        ids = np.flatnonzero(met)
        place = np.zeros(span, np.int32)
        place[ids] = np.arange(len(ids), dtype=np.int32)
        a, b = (np.concatenate([place[p[k] - low] for p in parts]) for k in (0, 1))
        return ids + low, a, b
    ids = np.unique(np.concatenate([x for p in parts for x in p[:2]]))
    a, b = (np.concatenate([np.searchsorted(ids, p[k]).astype(np.int32) for p in parts]) for k in (0, 1))
    return ids, a, b


def corners(parts: list[Arrays], direction: Direction, colours: int = 0) -> Arrays:
    """(id ascending, number of triangles at it that count) of the distinct edges (a, b and, unless `either`, their ways), a < b, in parts.

    With colours, triangles of one colour are left out. Vertices are ranked by their degree here, and the neighbours of
    higher rank of both ends of an edge are met, a portion of edges at a time.
    """
    ids, a, b = numbered(parts)
    ways = None if direction == "either" else np.concatenate([p[2].astype(np.uint8) for p in parts])
    parts.clear()
    n = len(ids)
    by_rank = np.argsort(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), kind="stable")
    rank = np.empty(n, np.int32)
    rank[by_rank] = np.arange(n, dtype=np.int32)
    a, b = rank[a], rank[b]
    key = np.minimum(a, b).astype(np.int64)
    key *= n
    key += np.maximum(a, b)
    bits = None
    if ways is None:
        key.sort()
    else:
        order = np.argsort(key)
        swapped, ways, key = (a > b)[order], ways[order], key[order]
        bits = np.where(swapped, (ways & 1) << 1 | ways >> 1, ways).astype(np.uint8)
    del a, b, ways
    source = (key // n).astype(np.int32)
    others = key
    others -= source.astype(np.int64) * n
    sizes = np.bincount(source, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)])
    width = slot_bits(sizes)
    slots = _slots(others, width)
    colour = place_of(ids[by_rank], colours) if colours else None
    at = [np.zeros(len(others), np.int32) for _ in range(2 if bits is None else 3)]  # by the place of u-v for u and v, of u-w for w
    for i in range(0, len(others), PORTION):
        edge = i + np.flatnonzero(sizes[others[i : i + PORTION]] > 0)
        v = others[edge]
        for uv, uw, vw in between(first, others, slots, width, edge, first[v], sizes[v]):
            if colour is not None:
                same = (colour[source[uv]] == colour[others[uv]]) & (colour[others[uv]] == colour[others[uw]])
                uv, uw, vw = uv[~same], uw[~same], vw[~same]
            for k, place in enumerate((uv, uw) if bits is None else (uv, uv, uw)):
                if bits is not None:
                    p, q, r = _CORNERS[direction][k]
                    place = place[(bits[uv] & p == p) & (bits[uw] & q == q) & (bits[vw] & r == r)]
                np.add.at(at[k], place, 1)
    found = np.zeros(n, np.int64)
    found[by_rank] = (np.bincount(source, at[0], n) + np.bincount(others, at[-1] if bits is None else at[1].astype(np.int64) + at[2], n) + (np.bincount(others, at[0], n) if bits is None else 0)).astype(np.int64)
    return ids[found > 0], found[found > 0]


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    z = ids.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    z >>= np.uint64(64 - bits)
    return z.astype(np.int32)


def _search(others: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of each w in the ascending others[lo:hi], -1 where it is none."""
    stop = hi
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (others[np.minimum(mid, len(others) - 1)] < w)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return np.where((lo < stop) & (others[np.minimum(lo, len(others) - 1)] == w), lo, -1)


def slot_bits(sizes: np.ndarray) -> int:
    """Bits of a hash, so that the most neighbours that a vertex has fill a 64th of the slots."""
    return int(np.clip(np.ceil(np.log2(64 * max(1, sizes.max()))), 10, 20))


def between(first: np.ndarray, others: np.ndarray, slots: np.ndarray, bits: int, edge: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[Arrays]:
    """(place of u to v, of u to w, of v to w) in others of the triangles of the edges at the ascending places `edge`; slots are the hashes of others.

    The n neighbours of an edge's v begin at its start. They are looked up among those of u: in a table of hashes
    that a few u share, then at the place that the slot tells, and by search where another neighbour has that slot.
    """
    if not len(edge):
        return
    source = np.searchsorted(first, edge, side="right") - 1
    rows = max(1, min(512, SLOTS >> bits))
    done, end = np.concatenate([[0], np.cumsum(n)]), len(edge)
    table, told = np.zeros(rows << bits, bool), np.zeros(rows << bits, np.int64)
    held, size = [], 0

    def checked() -> Arrays:
        nonlocal held, size
        by, far, at = map(np.concatenate, zip(*held))
        w = others[far]
        held, size = [], 0
        wrong = np.flatnonzero(others[at] != w)
        of = source[by[wrong]]
        at[wrong] = _search(others, first[of], first[of + 1], w[wrong])
        real = at >= 0
        return edge[by[real]], at[real], far[real]

    i = 0
    while i < end:
        low = source[i]
        j = min(int(np.searchsorted(source, low + rows)), max(i + 1, int(np.searchsorted(done, done[i] + WEDGES, side="right")) - 1))
        high = source[j - 1] + 1
        a, z = first[low], first[high]
        marks = np.repeat(np.arange(high - low) << bits, np.diff(first[low : high + 1])) + slots[a:z]
        table[marks] = True
        told[marks] = np.arange(a, z)
        sizes = n[i:j]
        place = np.repeat(start[i:j] - (done[i:j] - done[i]), sizes) + np.arange(done[j] - done[i])
        key = np.repeat((source[i:j] - low) << bits, sizes) + slots.take(place)
        found = np.flatnonzero(table.take(key))
        table[marks] = False
        if len(found):
            held.append((i + np.searchsorted(done[i : j + 1] - done[i], found, side="right") - 1, place[found], told.take(key[found])))
            size += len(found)
            if size >= CHECKED:
                yield checked()
        i = j
    if size:
        yield checked()


def _summed(ids: np.ndarray, n: np.ndarray) -> Arrays:
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    return ids[at], np.add.reduceat(n, at) if len(at) else n


def corner_counts(edges: DataFrame, direction: Direction = "either") -> DataFrame:
    """(id, triangles bigint): the triangles of the undirected simple graph at each vertex that has one, checkpointed.

    With `out` or `in` those whose other two are both in the vertex's neighbour set of that direction. Loops and repeated
    edges are harmless.
    """
    directed = direction != "either"
    edges = edges.select("src", "dst")
    n_edges = edges.count()
    c, places = colours_for(n_edges, largest_degree(edges, n_edges)), max(1, -(-n_edges // (PLACE_TASKS * TASK_LINKS)))
    columns = 3 if directed else 2

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = [unpack(x.as_buffer().to_pybytes(), columns) for x in rows.column("blob")]
        found = corners(parts, direction, c if len({k.as_py() for k in key}) == 2 else 0)
        out = list(_dealt(found, places, ordered=True))
        return pa.Table.from_batches(out) if out else pa.schema([("place", pa.int64()), ("blob", pa.binary())]).empty_table()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = _summed(*_joined(batches, 2))
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["id", "triangles"])

    third = classes(edges, c, directed).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    triple = F.array_sort(F.array("x", "y", "z"))
    triples = third.select(*(triple[k].alias(name) for k, name in enumerate("xyz")), "blob")
    found = triples.groupBy("x", "y", "z").applyInArrow(run, "place bigint, blob binary").repartitionById(places, F.col("place").cast("int"))
    return cut_lineage(found.mapInArrow(total, "id bigint, triangles bigint").coalesce(-(-places // 8)))  # fewer files, a place in memory at a time


def triangles(g: Graph) -> DataFrame:
    """(id, triangles) of every vertex in the undirected simple graph."""
    count = corner_counts(g.edges)
    return g.vertices.select("id").join(count, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))
