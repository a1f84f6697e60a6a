"""Exact removal of repeated passages by prefix-free parsing.

Every window of `window` bytes has a trigger: the leftmost k-gram of least rolling hash in it. Consecutive windows
with one trigger form a phrase, so phrases overlap by window - 1 bytes, none is a proper prefix of another at its
trigger, every window lies in exactly one phrase of its text, and equal windows lie at the same place relative to
equal triggers, wherever they occur. Repeats are then found on the dictionary of distinct phrases, not on the texts:

1. a phrase whose trigger occurs once in the corpus holds no repeat;
2. a phrase that occurs twice or more is repeated as a whole;
3. phrases that share a trigger but differ are put into corpus order, in batches of whole trigger groups: the batch,
   which is highly repetitive, is parsed again, prefix-free, at a finer grain; the suffix arrays of that dictionary and of
   that parse combine into the order of all its windows, and windows are compared with their neighbours byte by byte;
4. a trigger with more than `group` distinct phrases would not fit one task: its windows are dealt by content over all
   tasks and counted, told by 128 bits, after cells of `cell` windows have been ruled out, if the bytes that their windows
   share occur once, or taken whole, if all their bytes occur twice. The answer is the same.

Occurrences (the parse) carry the dictionary's answers back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import bounded_batches, cut_lineage, table
from vertexlens.llm.textbytes import U64, Block, SpanHash, blocks_of, grouped, words_at

_POS_BITS = 20
_POS = U64((1 << _POS_BITS) - 1)
#: Window starts per piece of a longer text; a cut only splits a phrase in two, which steps 3 and 4 allow for.
_PIECE = 1 << 18


@dataclass(frozen=True)
class RepeatParams:
    """window: least repeat in bytes; gram: bytes of a trigger, a multiple of 8; group: distinct phrases per trigger that one task orders;

    cell: windows that are ruled out or taken together beyond that.
    """

    window: int = 200
    gram: int = 48
    group: int = 4096
    cell: int = 16


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    r = w - n
    return np.minimum(x[: len(x) - r], x[r:]) if r else x


def _trigger_places(gram: np.ndarray, p: RepeatParams) -> np.ndarray:
    """Place of the trigger of the window at each start, from the hashes of all grams: the leftmost one of least hash in it."""
    at = np.arange(len(gram), dtype=U64)
    return (_sliding_min((gram & ~_POS) | at, p.window - p.gram + 1) & _POS).astype(np.int64)


def phrases(b: Block, p: RepeatParams) -> tuple[np.ndarray, ...]:
    """(text of the block, first window start in the text, windows, trigger hash, phrase hash) of every phrase of the block."""
    w = p.window
    none = np.zeros(0, np.int64)
    if len(b.buf) < w or not (b.end - b.start >= w).any():
        return none, none, none, none.view(U64), none.view(U64)
    h = SpanHash(b.buf)
    gram = h.rolling(p.gram)
    pos = _trigger_places(gram, p)
    mark = np.zeros(len(pos) + 1, np.int32)
    fits = b.end - b.start >= w
    np.add.at(mark, b.start[fits], 1)
    np.add.at(mark, b.end[fits] - w + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    new = np.ones(len(pos) + 1, bool)
    new[1:-1] = (pos[1:] != pos[:-1]) | (valid[1:] != valid[:-1])
    s, e = np.flatnonzero(valid & new[:-1]), np.flatnonzero(valid & new[1:])
    doc = np.searchsorted(b.start, s, side="right") - 1
    return doc, s - b.start[doc], e - s + 1, gram[pos[s]], h(s, e + w)


def _merged(s: np.ndarray, n: np.ndarray) -> list[dict]:
    """Runs of windows, joined where one begins where another ends."""
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != (s + n)[:-1]
    first = np.flatnonzero(new)
    return [{"s": int(a), "n": int(b)} for a, b in zip(s[first], np.add.reduceat(n, first))]


def parsed(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, s, n, trigger, phrase, more) of the phrases of texts(key, packed body): one row per distinct phrase of a piece of a text.

    more is null, or, for a phrase that the piece has twice or more, the window runs of all its occurrences: texts that
    repeat themselves with a short period would else give a row every few bytes.
    """
    run_type = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            row, offset, piece = [], [], []
            for r, t in enumerate(map(unpacked, batch.column(1).to_pylist())):
                for o in range(0, max(1, len(t) - p.window + 1), _PIECE):
                    row.append(r)
                    offset.append(o)
                    piece.append(t if len(t) <= _PIECE else t[o : o + _PIECE + p.window - 1])
            row, offset = np.array(row, np.int64), np.array(offset, np.int64)
            for b in blocks_of(piece, 1 << 18):
                doc, s, n, trigger, phrase = phrases(b, p)
                s = s + offset[b.first + doc]
                _, first, inverse, times = np.unique(grouped(doc, phrase), return_index=True, return_inverse=True, return_counts=True)
                more: list[list[dict] | None] = [None] * len(first)
                if (times > 1).any():
                    order = np.argsort(inverse, kind="stable")
                    ends = np.cumsum(times)
                    for g in np.flatnonzero(times > 1):
                        at = order[ends[g] - times[g] : ends[g]]
                        more[g] = _merged(s[at], n[at])
                columns = [pa.array(keys[row[b.first + doc[first]]]), pa.array(s[first].astype(np.int32)), pa.array(n[first].astype(np.int32)), pa.array(trigger[first].view(np.int64)), pa.array(phrase[first].view(np.int64)), pa.array(more, run_type)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "s", "n", "trigger", "phrase", "more"])

    return texts.mapInArrow(run, "key bigint, s int, n int, trigger bigint, phrase bigint, more array<struct<s:int,n:int>>")


#: Triggers of the fine parse: grams of 8 bytes whose hash is a multiple of this.
_FINE = 32
_GRAM = 8


def _refined(rank: np.ndarray, tied: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Orders the places `tied`, whose ranks others share, by `after` as well; which of them still share theirs.

    A rank is the number of places before its first one, so no other place's rank changes.
    """
    key = rank[tied] * (int(after.max(initial=0)) + 1) + after
    order = np.argsort(key)
    key, own, at = key[order], rank[tied][order], np.arange(len(order))
    new, other = np.ones(len(order) + 1, bool), np.ones(len(order), bool)
    new[1:-1], other[1:] = key[1:] != key[:-1], own[1:] != own[:-1]
    first = lambda flag: np.maximum.accumulate(np.where(flag, at, 0))
    rank[tied[order]] = own + first(new[:-1]) - first(other)
    return tied[order[~(new[:-1] & new[1:])]]


def _doubled(first: np.ndarray, left: np.ndarray, reach: int) -> np.ndarray:
    """Ranks, from 0, of suffixes by prefix doubling from the values of their first `reach` symbols; left: symbols to each one's end."""
    n = len(first)
    order = np.argsort(first)
    new = np.append(True, first[order[1:]] != first[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = order[~(new & np.append(new[1:], True))]
    tied = _refined(rank, tied, np.minimum(left[tied], reach))
    while (left[tied] > reach).any():
        tied = tied[left[tied] >= reach]  # shorter ones that are tied are equal; those that end here come before those that go on
        tied = _refined(rank, tied, np.where(left[tied] > reach, rank[np.minimum(tied + reach, n - 1)] + 1, 0))
        reach *= 2
    return rank


def corpus_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): all places of the joined parts in the order of the suffixes of their parts, and each part's first place.

    Prefix-free parsing: grams whose hash is a multiple of _FINE are triggers, a phrase goes from a trigger through the next,
    and none is a prefix of another. The suffix array of the parse orders what follows a phrase, that of the dictionary orders
    the ends of phrases; a place's order is that of its phrase's end, then that of the parse behind it.
    """
    text, size = b"".join(parts), np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(size)
    first = ends - size
    if not text:
        return np.zeros(0, np.int64), first
    gram = SpanHash(np.frombuffer(text, np.uint8), 7).rolling(_GRAM)
    trigger = np.flatnonzero(gram >> U64(40) & U64(_FINE - 1) == 0)
    owner = np.searchsorted(ends, trigger, side="right")
    trigger = trigger[(trigger + _GRAM <= ends[owner]) & (trigger > first[owner])]
    begin = np.sort(np.concatenate([first[size > 0], trigger]))
    part = np.searchsorted(ends, begin, side="right")
    last = np.ones(len(begin), bool)  # phrases that end with their part, not with a trigger
    last[:-1] = part[1:] != part[:-1]
    stop = np.where(last, ends[part], np.append(begin[1:], 0) + _GRAM)
    stop = np.minimum(stop, ends[part])
    seen: dict[bytes, int] = {}
    parse = np.array([seen.setdefault(text[a:z], len(seen)) for a, z in zip(begin.tolist(), stop.tolist())])
    entries = list(seen)
    by_text = np.array(sorted(range(len(entries)), key=entries.__getitem__))
    rank = np.empty(len(entries), np.int64)
    rank[by_text] = np.arange(1, len(entries) + 1)
    # suffix array of the parse, part by part
    phrases_left = ends_of_runs(part) - np.arange(len(part))
    behind = np.append(_doubled(rank[parse], phrases_left, 1)[1:] + 1, 0)
    behind[last] = 0
    # suffix array of the dictionary, entry by entry
    length = np.array([len(x) for x in entries])
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(entries), np.uint8)
    left = np.repeat(start + length, length) - np.arange(len(flat))
    head = words_at(flat)[:-1].byteswap()
    head &= ~((U64(1) << (U64(64) - U64(8) * np.minimum(left, 8).astype(U64))) - U64(1))  # nothing beyond the entry
    suffix = _doubled(head, left, 8)
    # both together
    own = np.append(begin[1:], len(text)) - begin
    at = np.arange(len(text)) - np.repeat(begin, own)
    order = np.argsort(suffix[np.repeat(start[parse], own) + at] * (len(parse) + 1) + np.repeat(behind, own), kind="stable")
    return order, first


def ends_of_runs(x: np.ndarray) -> np.ndarray:
    """For each place of x, where its run of equal values ends."""
    edge = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1
    return np.repeat(edge, np.diff(edge, prepend=0))


def repeated_windows(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part, which of its windows also occur elsewhere in the parts: neighbours in corpus order of equal bytes."""
    place, first = corpus_order(parts)
    size = np.array([len(x) for x in parts])
    place = place[np.repeat(first + size, size)[place] - place >= window]
    at = words_at(np.frombuffer(b"".join(parts), np.uint8))
    alike = np.arange(max(0, len(place) - 1))  # neighbours not yet told apart, from their last bytes on
    for k in [window - 8, *range(0, window - 8, 8)]:
        alike = alike[at[place[alike] + k] == at[place[alike + 1] + k]]
    flags = np.zeros(int(size.sum()), bool)
    flags[place[alike]] = flags[place[alike + 1]] = True
    return [flags[a : a + max(0, n - window + 1)] for a, n in zip(first.tolist(), size.tolist())]


def _runs(flags: np.ndarray) -> zip:
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return zip(a.tolist(), (z - a).tolist())


def packed_texts(texts: DataFrame) -> DataFrame:
    """texts(doc_id, body, rest) with zstandard bodies: they are written and shuffled, and the texts are most of what moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            body = pa.array([pack(x) for x in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), body, batch.column("rest")], ["doc_id", "body", "rest"])

    return texts.mapInArrow(run, texts.schema)


def unpacked(body: bytes) -> bytes:
    return zstandard.decompress(body)


def phrase_bytes(texts: DataFrame, wanted: DataFrame, p: RepeatParams) -> DataFrame:
    """(trigger, key, s, body) of the wanted phrases (key, s, n, trigger): their bytes, cut from the texts."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("trigger", "s", "n")).alias("cuts"))
    joined = texts.join(lists.hint("shuffle_hash"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trigger, key, at, part = [], [], [], []
            for k, packed, cuts in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "cuts"))):
                body = unpacked(packed)
                for c in cuts:
                    trigger.append(c["trigger"])
                    key.append(k)
                    at.append(c["s"])
                    part.append(body[c["s"] : c["s"] + c["n"] + p.window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(trigger, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(part, pa.binary())], ["trigger", "key", "s", "body"])

    return joined.mapInArrow(run, "trigger bigint, key bigint, s int, body binary")


def by_corpus_order(parts: DataFrame, p: RepeatParams, batch_bytes: int = 1 << 18) -> DataFrame:
    """(key, s, n) runs of repeated windows of phrases (trigger, key, s, body), trigger group by trigger group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, now = 0, None

        def done() -> pa.RecordBatch:
            found = [(k, s + a, n) for (k, s, _), f in zip(held, repeated_windows([x for *_, x in held], p.window)) for a, n in _runs(f)]
            key, s, n = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], ["key", "s", "n"])

        for batch in batches:
            for t, k, s, body in zip(*(batch.column(c).to_pylist() for c in ("trigger", "key", "s", "body"))):
                if t != now and size >= batch_bytes:
                    yield done()
                    held, size = [], 0
                now = t
                held.append((k, s, body))
                size += len(body)
        if held:
            yield done()

    return parts.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, "key bigint, s int, n int")


def common_cells(parts: DataFrame, p: RepeatParams) -> DataFrame:
    """(trigger, phrase, key, s, n): the cells of phrases (key, s, body) whose common bytes occur twice or more.

    As with phrases, trigger is the hash of the common bytes and phrase that of all the bytes.

    A cell has the windows at `cell` consecutive distances from the trigger; the bytes that all of them share are the same
    wherever one of them occurs, so a cell whose common bytes occur once has no repeated window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start = np.asarray(batch.column("key")), np.asarray(batch.column("s"))
            for b in blocks_of(batch.column("body").to_pylist(), 1 << 18):
                h = SpanHash(b.buf)
                n = b.end - b.start - p.window + 1
                a = _trigger_places(h.rolling(p.gram), p)[b.start] - b.start
                lo, hi = (a - n + 1) // p.cell, a // p.cell
                count = hi - lo + 1
                doc = np.repeat(np.arange(len(n)), count)
                c = lo[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                near = a[doc] - c * p.cell  # the last window start of the cell, and where the common bytes begin
                first = np.maximum(0, near - p.cell + 1)
                last = np.minimum(n[doc] - 1, near)
                at = b.start[doc] + near
                core = h(at, at - p.cell + 1 + p.window)
                whole = h(b.start[doc] + first, b.start[doc] + last + p.window)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(keys[b.first + doc]), pa.array((start[b.first + doc] + first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["trigger", "phrase", "key", "s", "n"])

    return _repeated(parts.mapInArrow(run, "trigger bigint, phrase bigint, key bigint, s int, n int"), "trigger")


def _repeated(rows: DataFrame, *told: str) -> DataFrame:
    """The rows whose values of `told` occur twice or more; the join is on complements, so that hot values can be split."""
    names = [f"_{c}" for c in told]
    again = rows.groupBy(*told).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*(F.bitwise_not(c).alias(n) for c, n in zip(told, names)))
    return rows.withColumns({n: F.bitwise_not(c) for c, n in zip(told, names)}).join(again, names).select(*rows.columns)


def by_content(parts: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, s, n=1) of repeated windows, counted by 128 bits with pre-aggregation: for triggers of any number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.asarray(batch.column("key")), np.asarray(batch.column("s"))
            for b in blocks_of(batch.column("body").to_pylist(), 1 << 16):
                n = b.end - b.start - p.window + 1
                doc = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                at = b.start[doc] + i
                h = [SpanHash(b.buf, seed)(at, at + p.window).view(np.int64) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[b.first + doc]), pa.array((first[b.first + doc] + i).astype(np.int32)), *map(pa.array, h)], ["key", "s", "h", "g"])

    return _repeated(parts.mapInArrow(run, "key bigint, s int, h bigint, g bigint"), "h", "g").select("key", "s", F.lit(1).alias("n"))


def _dictionary(seen: DataFrame, times: Column, spans: Column) -> tuple[DataFrame, DataFrame]:
    """(phrase, check, c, one) of each distinct (trigger, phrase), and the spans (key, s, n) of those that occur twice or more."""
    rows = seen.withColumn("check", F.expr("trigger ^ phrase"))  # phrase and check stand for (trigger, phrase)
    dictionary = cut_lineage(rows.groupBy("phrase", "check").agg(times, F.min(F.struct("key", "s", "n")).alias("one")))
    repeated = dictionary.where("c > 1").select(F.bitwise_not("phrase").alias("_p"), "check")
    whole = rows.withColumn("_p", F.bitwise_not("phrase")).join(repeated, ["_p", "check"])
    return dictionary, whole.select("key", F.inline(spans))


def repeated_spans(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, spans array<struct<s, n>>): runs of n repeated windows from byte s, for texts(key, packed body).

    texts has all the columns that the caller joins later: the plans then share one shuffle of the texts. Joins are on
    complements of grouping keys, so that Spark can split a hot trigger.
    """
    rows = parsed(texts.select("key", "body"), p)
    times = F.sum(F.when(F.col("more").isNull(), 1).otherwise(2)).alias("c")
    shared = rows.groupBy("trigger").agg(times).where("c > 1").select(F.bitwise_not("trigger").alias("t"))
    seen = rows.withColumn("t", F.bitwise_not("trigger")).join(shared, "t").select("key", "s", "n", "trigger", "phrase", "more")
    dictionary, whole = _dictionary(cut_lineage(seen), times, F.coalesce("more", F.array(F.struct("s", "n"))))
    entries = dictionary.select("one.key", "one.s", "one.n", F.expr("phrase ^ check").alias("trigger"))
    sizes = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.bitwise_not("trigger").alias("t"), "m")
    differing = cut_lineage(entries.withColumn("t", F.bitwise_not("trigger")).join(sizes, "t").select("key", "s", "n", "trigger", "m"))
    few = by_corpus_order(phrase_bytes(texts, differing.where(f"m <= {p.group}").drop("m"), p), p)
    cells = cut_lineage(common_cells(phrase_bytes(texts, differing.where(f"m > {p.group}").drop("m"), p), p))
    cell_dictionary, whole_cells = _dictionary(cells, F.count(F.lit(1)).alias("c"), F.array(F.struct("s", "n")))
    left = cell_dictionary.select("one.key", "one.s", "one.n", F.col("phrase").alias("trigger"))
    many = whole_cells.unionByName(by_content(phrase_bytes(texts, left, p), p))
    spans = whole.unionByName(few).unionByName(many)
    return spans.groupBy("key").agg(F.collect_list(F.struct("s", "n")).alias("spans"))


def byte_runs(size: int, spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs [a, z) of runs of n windows from s."""
    d = np.zeros(size + 1, np.int32)
    for x in spans:
        d[x["s"]] += 1
        d[x["s"] + x["n"] + window - 1] -= 1
    return [(a, a + n) for a, n in _runs(np.cumsum(d[:-1]) > 0)]


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text and the columns named in `keep`, for every row.

    A null text is empty: nothing is removed and kept_text is null. A repeated row is another document, so its bytes
    (from `window` on) go. Where a removed run ends inside a character, kept_text drops the character's rest; the digest is
    of the bytes. Rows are numbered as they are written, once, so null and repeated ids are allowed.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    packed = packed_texts(bounded_batches(docs).select("doc_id", body.alias("body"), F.struct(F.col("text").isNull().alias("_null"), *keep).alias("rest")))
    texts = cut_lineage(packed.withColumn("key", F.monotonically_increasing_id()))
    spans = repeated_spans(texts, p)
    joined = texts.join(spans.hint("shuffle_hash"), "key", "left")
    names = ["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, digest, kept = [], [], [], [], []
            for packed, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                body = unpacked(packed)
                cut = byte_runs(len(body), spans, p.window) if spans else []
                size.append(len(body))
                removed.append(sum(z - a for a, z in cut))
                count.append(len(cut))
                if cut:
                    ends = [0, *(x for r in cut for x in r), len(body)]
                    body = b"".join(body[a:z] for a, z in zip(ends[::2], ends[1::2]))
                digest.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names)

    rest = texts.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(run, f"doc_id bigint, rest {rest}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    text = F.when(~F.col("rest._null"), F.col("kept_text")).alias("kept_text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text, *(F.col(f"rest.`{c}`") for c in keep))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP10_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 400) as x from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as p from d)),
r as (select doc_id, p from w where x in (select x from w group by x having count(*) > 1)),
g as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 200 then 0 else 1 end as new from r),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from g),
s as (select doc_id, run, min(p) as a, max(p) + 200 as z from i group by doc_id, run),
k as (select doc_id, h, a, coalesce(lag(z) over (partition by doc_id order by a), 0) as before, z, row_number() over (partition by doc_id order by a desc) as last from s join d using (doc_id)),
kept as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans,
    sha256(unhex(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || max(case when last = 1 then substr(h, 2 * z + 1) else '' end))) as kept_sha256 from k group by doc_id)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    coalesce(kept_sha256, sha256(encode(d.text))) as kept_sha256 from d left join kept using (doc_id)
"""
