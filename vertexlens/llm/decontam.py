"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton of all items is walked once per training text: each word either extends the current match or
falls back along suffix links, so the length of the longest item passage ending at every word is known in
linear time. Passages of at least `window` words (or a whole shorter item) hit the words they cover.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import id_and_bytes, table


@dataclass(frozen=True)
class DecontamParams:
    """window: item words that count as a leak. A text is contaminated if hits >= 1 / share_denominator of its words.

    block_words: most item words per automaton. A larger benchmark is cut into more automata, each walked by every text;
    the driver and a worker hold one at a time.
    """

    window: int = 13
    share_denominator: int = 20
    block_words: int = 200_000


#: Words are runs of digits, letters and non-ASCII characters; A-Z are lower-cased.
_TO_WORD = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))


def words(body: bytes) -> list[bytes]:
    return body.translate(_TO_WORD).split()


class SuffixAutomaton:
    """Of several word sequences. State 0 is the root; nxt[s] maps a word number to a state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.nxt: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [k for k, _ in items]
        numbered = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for ws in numbered:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._mark(numbered)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.nxt.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.nxt) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.nxt, self.link, self.length
        if w in nxt[last]:  # the sequence so far is known: reuse or split its state
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur, p = self._state(length[last] + 1, 0, {}), last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.nxt, self.link
        copy = self._state(self.length[p] + 1, link[q], dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, numbered: list[list[int]]) -> None:
        """in_window[s]: items with an occurrence of s's window-long suffix class; whole[s]: short items that end every match at s."""
        self.in_window: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state -> (words, item)
        for k, ws in enumerate(numbered):
            s = n = 0
            for w in ws:
                s, n = self.nxt[s][w], n + 1
                while self.length[self.link[s]] >= self.window:  # forget all but the last `window` words, at most the class's shortest
                    s = self.link[s]
                n = min(n, self.length[s])
                if n >= self.window:
                    self.in_window.setdefault(s, set()).add(k)
            if 0 < len(ws) < self.window:
                self.whole.setdefault(s, []).append((len(ws), k))
        # A match at s also ends every shorter passage on its suffix links.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.nxt)
        for s in sorted(range(1, len(self.nxt)), key=self.length.__getitem__):
            self.short[s] = self.short[self.link[s]] + tuple(self.whole.get(s, ()))
        # below this many consecutive item words nothing can be hit
        self.least = min([self.window, *(len(ws) for ws in numbered if ws)])

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges [a, z) (not merged) and the items whose windows occur."""
        get, nxt, link, length, window, short = self.vocab.get, self.nxt, self.link, self.length, self.window, self.short
        ids = list(map(get, ws))
        known = np.fromiter((x is not None for x in ids), np.bool_, len(ids))
        edge = np.diff(known.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.least
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, z in zip(starts[long].tolist(), ends[long].tolist()):
            s = n = 0
            for i in range(a, z):
                w = ids[i]
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if w in nxt[s]:
                    s, n = nxt[s][w], n + 1
                else:
                    n = 0
                if n >= window:
                    found.append((i + 1 - n, i + 1))
                    t = s
                    while length[link[t]] >= window:
                        t = link[t]
                    items |= self.in_window[t]
                for k, item in short[s]:
                    if k <= n:
                        found.append((i + 1 - k, i + 1))
                        items.add(item)
        return found, items


def automata(items: DataFrame, p: DecontamParams) -> DataFrame:
    """(automaton binary): the benchmark's pickled automata, built in tasks. Items without words (null, empty) are left out.

    Each holds at most block_words words: an item that has more is cut into parts that overlap by window - 1 words, so
    every window lies whole in one of them.
    """
    rows = items.select(F.col("item_id").cast("string").alias("k"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    most = max(p.block_words, 2 * p.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[bytes]]] = []
        room = most

        def built() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(SuffixAutomaton(held, p.window), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["automaton"])

        for batch in batches:
            for k, body in zip(batch.column("k").to_pylist(), batch.column("body").to_pylist()):
                ws = words(body)
                for i in range(0, max(1, len(ws) - p.window + 1), most - p.window + 1):
                    part = ws[i : i + most]
                    if len(part) > room:
                        yield built()
                        held, room = [], most
                    if part:
                        held.append((k, part))
                        room -= len(part)
        if held:
            yield built()

    # a word and the space behind it have two bytes at least, so the parts are about a block each
    return rows.repartition(max(1, -(-size // (6 * most)))).mapInArrow(run, "automaton binary")


def walkers(sent: list[Broadcast], cached: dict[int, SuffixAutomaton]) -> Iterator[SuffixAutomaton]:
    """The automata in turn. A single one is kept from batch to batch; of several one is in memory at a time."""
    for i, b in enumerate(sent):
        w = cached.get(i) or pickle.loads(b.value)
        b.__dict__.pop("_value", None)  # the worker's copy of the bytes; they stay in the executor's files
        if len(sent) == 1:
            cached[i] = w
        yield w


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def leaks(docs: DataFrame, items: DataFrame, p: DecontamParams = DecontamParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans array<struct<a, z>> and the columns of `keep`, of every row.

    spans are the maximal hit runs of words. A null or empty text has no words, hits nothing and is not
    contaminated; n_items then is 0 and items_sha256 that of the empty string. Repeated rows stay repeated, items
    of one id count once; the windows of an item without id hit like any, but it is not counted or named. Other columns
    are ignored. An empty benchmark hits nothing, an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(bytes(r["automaton"])) for r in automata(items, p).toLocalIterator()]  # one block at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[int, SuffixAutomaton] = {}
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            hits: list[list[tuple[int, int]]] = [[] for _ in bodies]
            found: list[set[str]] = [set() for _ in bodies]
            n_words = [0 if sent else len(words(body)) for body in bodies]
            for w in walkers(sent, cached):
                for i, body in enumerate(bodies):
                    ws = words(body)
                    n_words[i] = len(ws)
                    more, items_of = w.spans(ws)
                    hits[i] = merged(hits[i] + more)
                    found[i].update(w.items[k] for k in items_of if w.items[k] is not None)
            n_hit = [sum(z - a for a, z in h) for h in hits]
            n_items = [len(f) for f in found]
            digest = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
            spans = [[{"a": a, "z": z} for a, z in h] for h in hits]
            bad = [h > 0 and p.share_denominator * h >= n for h, n in zip(n_hit, n_words)]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, kind), *batch.columns[2:]], [*names, *keep])

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return id_and_bytes(docs, keep=keep).mapInArrow(run, f"doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<a bigint, z bigint>>{kinds}")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = r"""
with split as (select 'd' as kind, doc_id::varchar as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 'i', item_id::varchar, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
iw as (select id, least(13, len(ws)) as k, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as i, ws from split where kind = 'i' and len(ws) > 0),
win as (select distinct id, k, array_to_string(ws[i : i + k - 1], ' ') as w from iw),
ks as (select distinct k from win),
dw as (select id, k, unnest(range(1, len(ws) - k + 2)) as i, ws from split, ks where kind = 'd' and len(ws) >= k),
hit as (select dw.id, dw.i, dw.k, win.id as item from dw join win on win.k = dw.k and win.w = array_to_string(dw.ws[dw.i : dw.i + dw.k - 1], ' ')),
covered as (select id, count(distinct j) as n from (select id, unnest(range(i, i + k)) as j from hit) group by id),
its as (select id, count(distinct item) as n, sha256(string_agg(distinct item, ',' order by item)) as h from hit group by id),
r as (select s.id::bigint as doc_id, len(ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
        coalesce(t.h, sha256('')) as items_sha256 from split s left join covered c using (id) left join its t using (id) where kind = 'd')
select *, n_hit > 0 and 20 * n_hit >= n_words as contaminated from r
"""
