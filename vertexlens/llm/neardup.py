"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A signature has chunks x width symbols of 16 bits; the distance of two signatures is the number of symbols that differ.
Two signatures closer than chunks x (errors + 1) agree, by pigeonhole, in some chunk up to `errors` symbols; enumerating
which symbols of a chunk may be wrong turns that into equality of keys. So all pairs within distance chunks x (errors + 1)
- 1 meet under some key: nothing is cut off, however large a key's group. Further pairs may meet too; those up to
distance `far` are candidates as well.

Texts with equal shingle sets are one class, and no pair of classes is listed. What is compared, and where:

1. signatures, within each key's group (groups of the same members once), in square blocks: a block returns a spanning
   forest of its pairs within `far`. Boilerplate that makes texts share keys goes no further than this;
2. full shingle sets, within the components of those forests: each class with the component's least class;
3. full sets of the classes that failed it (few in a group of copies) with all the classes of their component, in blocks,
   for the pairs within `far` that links already found do not connect.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import broadcast_if_small, cut_lineage, id_and_bytes, table
from vertexlens.llm.textbytes import IS_SPACE, LOWER, U64, Block, SpanHash, blocks, mix, owner, runs
from vertexlens.operators.components import component_map


@dataclass(frozen=True)
class NearDupParams:
    """Links: 100 * |A & B| >= percent * |A | B| over distinct shingles of `words` words.

    A pair at the threshold is missed if every chunk has more than `errors` differing symbols or more than `far` of all
    differ. By the binomial distribution that is under 6e-7 a pair for 17 chunks and far=48 at 80 %, and under 5e-7 for 12
    chunks and far=31 at 85 %. block and block_bytes: signatures, and sets and their bytes, per side of a comparison.
    """

    words: int = 5
    percent: int = 80
    chunks: int = 17
    width: int = 7
    errors: int = 1
    far: int = 48
    block: int = 1024
    block_bytes: int = 32 << 20
    seed: int = 1

    @property
    def symbols(self) -> int:
        return self.chunks * self.width


OP4_PARAMS = NearDupParams(words=3, percent=85, chunks=12, far=31)


def shingles(b: Block, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n_words per text, hash) of every shingle of the block; a text of fewer words is one shingle."""
    buf = LOWER[b.buf]
    ws, we = runs(~IS_SPACE[buf])
    doc, h = owner(b, ws), SpanHash(buf)(ws, we)
    n = np.bincount(doc, minlength=len(b.start))
    first = np.cumsum(n) - n
    length = np.where(n >= words, words, n)  # of the shingles of each text
    starts = np.arange(len(ws))
    keep = starts - first[doc] <= (n - length)[doc]
    starts = starts[keep]
    doc, k = doc[keep], length[doc[keep]]
    out = np.zeros(len(starts), U64)
    for i in range(words):
        more = i < k
        at = starts[more] + i
        out[more] = mix(out[more] * U64(0x9E3779B97F4A7C15) + h[at] + U64(i + 1))
    return doc, n, out


def distinct(b: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text into the sorted distinct shingle hashes."""
    doc, _, h = shingles(b, words)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(b.start) + 1)), h


class MinHasher:
    """Signatures of sorted distinct shingle hashes: per symbol the least of 32-bit permuted hashes, cut to 16 bits."""

    def __init__(self, p: NearDupParams):
        r = np.random.default_rng(p.seed)
        odd = lambda: r.integers(0, 1 << 31, p.symbols, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.rounds = list(zip(r.integers(0, 1 << 32, p.symbols, dtype=np.uint32), odd(), odd()))

    def __call__(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of symbols for the sets that begin at the places `at` (none empty)."""
        sig = np.empty((len(at), len(self.rounds)), np.uint16)
        if not len(at):
            return sig
        low = (h >> U64(32)).astype(np.uint32)
        x, y = np.empty_like(low), np.empty_like(low)
        for j, (c, a, b) in enumerate(self.rounds):
            np.bitwise_xor(low, c, out=x)
            np.multiply(x, a, out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, b, out=x)
            np.right_shift(x, np.uint32(13), out=y)
            np.bitwise_xor(x, y, out=x)
            least = np.minimum.reduceat(x, at)
            sig[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return sig


def set_prints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the sets that begin at the places `at` (none empty)."""
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64)
    return np.add.reduceat(mix(h + U64(1)), at), np.add.reduceat(mix(h ^ U64(0xF1357AEA2E62A9C5)), at)


def sketch(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """doc_id, k1, k2 (passed on), n_shingles, set_a, set_b (128-bit fingerprint of the set), sig (16-bit symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(p)
        for batch in batches:
            for b in blocks(batch.column(1), 1 << 18):
                at, h = distinct(b, p.words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                fa, fb = np.zeros(len(n), U64), np.zeros(len(n), U64)
                fa[full], fb[full] = set_prints(h, at[full])
                sigs: list[bytes | None] = [None] * len(n)
                for i, row in zip(full.tolist(), hasher(h, at[full])):
                    sigs[i] = row.tobytes()
                part = slice(b.first, b.last)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[part] for c in ("doc_id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array(sigs, pa.binary())], names)

    names = ["doc_id", "k1", "k2", "n_shingles", "set_a", "set_b", "sig"]
    return docs.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary")


def chunk_keys(p: NearDupParams) -> Column:
    """All keys of a signature: each chunk with each choice of `errors` of its symbols left out."""
    keys = []
    for c in range(p.chunks):
        for out in itertools.combinations(range(p.width), p.errors):
            cuts = [-1, *out, p.width]
            parts = [F.substring("sig", 2 * (c * p.width + a + 1) + 1, 2 * (z - a - 1)) for a, z in itertools.pairwise(cuts) if z - a > 1]
            keys.append(F.xxhash64(F.lit(len(keys)), *parts))
    return F.array(*keys)


def shingle_sets(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """nid, cl, sig and the sorted distinct shingle hashes (set: 8 bytes each) of docs(nid, cl, body), whose texts have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(p)
        for batch in batches:
            for b in blocks(batch.column("body"), 1 << 18):
                at, h = distinct(b, p.words)
                sets, sigs = [h[i:j].tobytes() for i, j in itertools.pairwise(at)], [row.tobytes() for row in hasher(h, at[:-1])]
                part = slice(b.first, b.last)
                yield pa.RecordBatch.from_arrays([batch.column("nid")[part], batch.column("cl")[part], pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["nid", "cl", "sig", "set"])

    return docs.mapInArrow(run, "nid bigint, cl bigint, sig binary, set binary")


def linked(a: np.ndarray, b: np.ndarray, p: NearDupParams) -> bool:
    """Whether two sorted sets are similar enough, by their exact intersection."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < p.percent * len(large):
        return False
    at = np.searchsorted(large, small)
    n = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * n >= p.percent * (len(a) + len(b) - n)


def near_pairs(left: np.ndarray, right: np.ndarray, p: NearDupParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, distance) of the signatures within distance `far`, nearest first."""
    found = []
    step = max(1, (1 << 20) // max(1, len(right)))
    columns = np.ascontiguousarray(right.T)
    for i in range(0, len(left), step):
        d = np.zeros((len(left[i : i + step]), len(right)), np.uint16)
        for j, c in enumerate(columns):
            d += left[i : i + step, j, None] != c
        x, y = np.nonzero(d <= p.far)
        found.append((x + i, y, d[x, y]))
    x, y, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(d, kind="stable")
    return x[order], y[order], d[order]


class Forest:
    """Union-find over the members of one comparison."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _signatures(sigs: list[bytes], p: NearDupParams) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), p.symbols)


def near_forest(ids: list[int], side: list[int], sigs: list[bytes], p: NearDupParams) -> list[tuple[int, int]]:
    """Forest of the pairs within distance `far`, of side 0 among themselves, or of side 0 with side 1 where that is there."""
    sig, at = _signatures(sigs, p), np.array(side)
    left, right = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
    x, y, _ = near_pairs(sig[left], sig[right if len(right) else left], p)
    x, y = left[x], (right if len(right) else left)[y]
    forest = Forest(len(ids))
    return [(ids[i], ids[j]) for i, j in zip(x.tolist(), y.tolist()) if i != j and forest.join(i, j)]


def in_groups(rows: DataFrame, key: tuple[str, ...], values: tuple[str, ...], links: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what links(values...) gives for each group of `key`, from bounded groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch | None:
            found = links(*map(list, zip(*held))) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"]) if found else None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, *values))):
                if row[: len(key)] != now:
                    if out := done():
                        yield out
                    now, held = row[: len(key)], []
                held.append(row[len(key) :])
        if out := done():
            yield out

    dealt = rows.select(*key, *values).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _part(count: Column, p: NearDupParams) -> Column:
    return F.ceil(count / p.block).cast("int")


def near_components(classes: DataFrame, p: NearDupParams) -> DataFrame:
    """(nid, cl): components of the pairs of classes(nid, sig) that share a key and are within distance `far`."""
    keys = classes.select("nid", F.explode(chunk_keys(p)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(keys.join(shared, "key"))
    # keys with the same members are one group; a group is told by 128 bits of its members
    told = members.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("y"))
    groups = told.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    rows = members.join(groups, "key").withColumn("parts", _part(F.col("n"), p)).join(classes.select("nid", "sig"), "nid")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("nid", F.lit(3)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("key", "nid", "sig", "part", other)
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "nid", "sig")
    edges = in_groups(rows, ("key", "i", "j"), ("nid", "side", "sig"), lambda ids, side, sigs: near_forest(ids, side, sigs, p))
    return component_map(edges).select(F.col("id").alias("nid"), F.col("component").alias("cl"))


def least_links(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """sets with ok: whether the class links with the least of its component; it is null for that one itself."""
    least = sets.where("nid = cl").select("cl", F.col("set").alias("least"))
    names = ["nid", "cl", "ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [None if i == c else linked(np.frombuffer(s, U64), np.frombuffer(t, U64), p) for i, c, s, t in zip(*(batch.column(c).to_pylist() for c in ("nid", "cl", "set", "least")))]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), batch.column("cl"), pa.array(ok, pa.bool_())], names)

    return sets.select("nid", "cl", "set").join(least, "cl").mapInArrow(run, "nid bigint, cl bigint, ok boolean")


def open_links(ids: list[int], side: list[int], tied: list[bool], sigs: list[bytes], sets: list[bytes], p: NearDupParams) -> list[tuple[int, int]]:
    """Forest of the confirmed links of side 0 with side 1; members that are `tied` are known to be connected."""
    sig, at = _signatures(sigs, p), np.array(side)
    left, right = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
    x, y, _ = near_pairs(sig[left], sig[right], p)
    forest, arrays, found = Forest(len(ids)), [np.frombuffer(s, U64) for s in sets], []
    first: dict = {}
    for i, t in enumerate(tied):  # tied members are one, and so is a class on both sides
        for k in [("tied",)] * t + [ids[i]]:
            forest.join(first.setdefault(k, i), i)
    for i, j in zip(left[x].tolist(), right[y].tolist()):
        if forest.find(i) != forest.find(j) and linked(arrays[i], arrays[j], p):
            forest.join(i, j)
            found.append((ids[i], ids[j]))
    return found


def confirmed_links(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b): links on full sets that connect what is connected among sets(nid, cl, sig, set)."""
    first = cut_lineage(least_links(sets, p))
    room = lambda some: F.ceil(F.greatest(F.count_if(some) / p.block, F.sum(F.when(some, F.octet_length("set")).otherwise(0)) / p.block_bytes)).cast("int")
    marked = sets.join(first.where("not ok").select("nid", F.lit(True).alias("open")), "nid", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    # a row for each component with an open class; the join is on the complement, so that a large component can be split
    parts = marked.groupBy("cl").agg(room(F.lit(True)).alias("parts"), room(F.col("open")).alias("open_parts")).where("open_parts > 0")
    parts = cut_lineage(parts.select(F.bitwise_not("cl").alias("c"), "parts", "open_parts"))
    rows = marked.withColumn("c", F.bitwise_not("cl")).join(broadcast_if_small(parts), "c").withColumn("h", F.xxhash64("nid", F.lit(5)))
    tied = ~F.col("open")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod("h", F.col(n)).cast("int")
    ours = rows.where("open").select("cl", at("open_parts").alias("i"), every("parts").alias("j"), F.lit(0).alias("side"), "nid", tied.alias("tied"), "sig", "set")
    others = rows.select("cl", every("open_parts").alias("i"), at("parts").alias("j"), F.lit(1).alias("side"), "nid", tied.alias("tied"), "sig", "set")
    more = in_groups(ours.unionByName(others), ("cl", "i", "j"), ("nid", "side", "tied", "sig", "set"), lambda *columns: open_links(*columns, p))
    return first.where("ok").select(F.col("nid").alias("a"), F.col("cl").alias("b")).unionByName(more)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """k1, k2: 128 bits that tell rows of different id or text apart."""
    nulls = [F.col(c).isNull() for c in (doc_id, text)]
    return [F.xxhash64(*nulls, doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id, *nulls).alias("k2")]


def near_duplicate_groups(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """doc_id, k1, k2 (row_keys), n_shingles, nid of every row: nid is the same for the rows of a group, null without shingles."""
    keyed = docs.select("doc_id", "text", *row_keys())
    texts = id_and_bytes(keyed, keep=("k1", "k2"))
    rows = cut_lineage(sketch(texts, p))
    full = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("sig").alias("sig"))
    classes = cut_lineage(full.select("set_a", "set_b", "k.k1", "k.k2", "sig", F.monotonically_increasing_id().alias("nid")))
    near = cut_lineage(near_components(classes.select("nid", "sig"), p))
    wanted = broadcast_if_small(cut_lineage(classes.select("k1", "k2", "nid").join(near, "nid")))
    # one body for each class, however often its row is repeated
    bodies = texts.select("k1", "k2", "body").join(wanted, ["k1", "k2"]).groupBy("k1", "k2", "nid", "cl").agg(F.first("body").alias("body"))
    sets = cut_lineage(shingle_sets(bodies.select("nid", "cl", "body"), p))
    links = component_map(confirmed_links(sets, p))
    of_class = classes.join(links.withColumnRenamed("id", "nid"), "nid", "left").select("set_a", "set_b", F.coalesce("component", "nid").alias("nid"))
    return rows.select("doc_id", "k1", "k2", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left").select("doc_id", "k1", "k2", "n_shingles", "nid")


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    component_id is the smallest doc_id of the group that links connect; kept where it is the row's own doc_id. Null,
    empty and blank texts have no shingles, link with nothing and are kept. Equal texts always link. Ids may be null or
    repeated: rows are linked by their texts alone, and a group without any id has a null component_id and keeps
    all its rows. Other columns are ignored, whatever their names.
    """
    rows = cut_lineage(near_duplicate_groups(docs, p).drop("k1", "k2"))
    least = rows.where("nid is not null").groupBy("nid").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "nid", "left").select("doc_id", "n_shingles", F.when(F.col("nid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), OP4_PARAMS)


OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.id),
m as (select id, min(c) as c from r group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept from documents d left join n using (doc_id) join m on m.id = d.doc_id
"""
