"""Phrase collocation mining over vertical positional inverted lists.

Texts are dealt into blocks. A block keeps, for each of its words and phrases, the ascending positions where it occurs; a
phrase is extended by merge-joining its positions with those of the words right behind them, so the length of a list is the
exact number of occurrences. Only lengths go through a shuffle: they are summed by phrase over all blocks, each block is
told which of its phrases are frequent, and their lists are all that it keeps and extends.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlens.lineage import written
from vertexlens.llm.frames import bounded_batches, cut_lineage, table
from vertexlens.llm.textbytes import LOWER, blocks, byte_table, runs
from vertexlens.operators.triangles import pack, unpack

#: Pieces of a text end at these bytes, words of a piece at blanks and tabs.
_BREAK = byte_table(b".,;:!?\n\x0b\x0c\r")
_GAP = _BREAK | byte_table(b" \t")
#: Bytes of text in a block, and candidates that one task ranks.
_BLOCK_BYTES, _RANKED = 8 << 20, 1_000_000
#: Bits of a partition's block numbers, and of a block's phrase codes.
_BLOCK_BITS, _CODE_BITS = 10, 30


@dataclass(frozen=True)
class PhraseParams:
    """Phrases of 2 to `longest` words that occur `least` times; `top` of each language are returned.

    A phrase goes if a longer one that holds it occurs in at least `absorb` percent of its places.
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    absorb: int = 100


Lists = tuple[np.ndarray, np.ndarray]  # codes, ascending, and positions, ascending within each code


def inverted(code: np.ndarray, pos: np.ndarray) -> Lists:
    order = np.lexsort((pos, code))
    return code[order], pos[order]


def positions(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, text, position) of every word; the words of a piece have consecutive positions, those of two pieces have not."""
    found, owners, places, at = [], [], [], 0
    for b in blocks(texts):
        low = LOWER[b.buf]
        inside = ~_GAP[low]
        start, end = runs(inside)
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        found.append(pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside].tobytes())]))
        piece = np.cumsum(_BREAK[low], dtype=np.int64)[start]
        places.append(at + np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=0) != 0))
        at = places[-1][-1] + 2 if len(start) else at
        owners.append(b.first + np.searchsorted(b.start, start, side="right") - 1)
    return pa.concat_arrays(found), np.concatenate(owners), np.concatenate(places)


def extended(phrases: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, tail, position): each place where a phrase is continued by the word behind it.

    That word's postings are read from the lists of the phrases that end with it: the continued phrase's tail, of as many
    words, starts one place later. A phrase whose tail has no list is not frequent. The merge join is in order of position,
    where one phrase of a length starts at most.
    """
    order = np.argsort(phrases[1], kind="stable")
    code, pos = phrases[0][order], phrases[1][order]
    met = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return code[met], code[met + 1], pos[met]


_WORDS = pa.schema([("block", pa.int64()), ("lists", pa.binary()), ("at", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_LISTS = pa.schema([("block", pa.int64()), ("lists", pa.binary()), ("ids", pa.binary())])


def _rows(rows: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def word_lists(docs: DataFrame) -> DataFrame:
    """Of each block of docs(lang, text): a row with its lists, and rows (at, lang, word, n) of its distinct words; at is block and code."""
    texts = bounded_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("body"))

    def listed(block: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).combine_chunks()
        word, text, pos = positions(held.column(1).combine_chunks())
        if not len(pos):
            return
        langs, words = held.column(0).combine_chunks().dictionary_encode(), word.dictionary_encode()
        size = len(words.dictionary)
        key = langs.indices.to_numpy().astype(np.int64)[text] * size + words.indices.to_numpy()
        key, code, n = np.unique(key, return_inverse=True, return_counts=True)
        yield _rows(1, _WORDS, block=[block], lists=[pack(*inverted(code, pos))])
        yield _rows(len(key), _WORDS, at=(block << _CODE_BITS) + np.arange(len(key)), lang=langs.dictionary.take(pa.array(key // size)), word=words.dictionary.take(pa.array(key % size)), n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << _BLOCK_BITS, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _BLOCK_BYTES:
                yield from listed(block, held)
                block, held, size = block + 1, [], 0
        if held:
            yield from listed(block, held)

    return texts.mapInArrow(run, "block bigint, lists binary, at bigint, lang string, word string, n bigint")


def candidates(lists: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix id, tail id, n) of the distinct continuations of a block's phrases, by code, and (code, position) of each of their places."""
    (known,), held = unpack(ids, 1), unpack(lists, 2)
    prefix, tail, pos = extended(held)
    key, code, n = np.unique(prefix * max(1, len(known)) + tail, return_inverse=True, return_counts=True)
    return known[key // max(1, len(known))], known[key % max(1, len(known))], n, code, pos


def frequent_lists(level: DataFrame, told: DataFrame, longer: bool) -> DataFrame:
    """(block, lists, ids) of the frequent phrases told(at, id), from level: the lists of all words or, if longer, of the frequent phrases one word shorter.

    Candidates are found again from those, so only the lists of frequent ones are ever written.
    """

    def run(state: pa.Table, known: pa.Table) -> pa.Table:
        if not state.num_rows or not known.num_rows:
            return _LISTS.empty_table()
        lists = state.column("lists")[0].as_buffer().to_pybytes()
        code, pos = candidates(lists, state.column("ids")[0].as_buffer().to_pybytes())[3:] if longer else unpack(lists, 2)
        frequent = known.column("at").to_numpy() & (1 << _CODE_BITS) - 1
        order = np.argsort(frequent)
        frequent, ids = frequent[order], known.column("id").to_numpy()[order]
        at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
        stays = frequent[at] == code
        return pa.Table.from_batches([_rows(1, _LISTS, block=state.column("block")[:1], lists=[pack(*inverted(at[stays], pos[stays]))], ids=[pack(ids)])])

    state = level.where("lists is not null").select("block", "lists", *(["ids"] if longer else []))
    keys = told.select(F.shiftright("at", _CODE_BITS).alias("of"), F.col("at").alias("at"), "id")
    return state.groupBy("block").cogroup(keys.groupBy("of")).applyInArrow(run, "block bigint, lists binary, ids binary")


def longer_counts(level: DataFrame) -> DataFrame:
    """(at, prefix, tail, n) of each block's distinct candidates; prefix and tail are the ids of the phrases that are all but their last and first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lists, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                prefix, tail, n, *_ = candidates(lists.as_buffer().to_pybytes(), ids.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array((block << _CODE_BITS) + np.arange(len(n))), pa.array(prefix), pa.array(tail), pa.array(n)], ["at", "prefix", "tail", "n"])

    return level.mapInArrow(run, "at bigint, prefix bigint, tail bigint, n bigint")


def frequent_phrases(docs: DataFrame, p: PhraseParams) -> tuple[DataFrame, list[DataFrame]]:
    """(totals(lang, n), levels): levels[0](id, lang, word, f), then (id, prefix, tail, f) of each longer length, all frequent ones.

    An id is the least (block, code) of the phrase, so no two phrases of a length share one. Counts are shuffled once: they
    are summed by phrase, and the sum is told to each of the phrase's blocks from there. A block tells of each of its
    phrases once, whatever it counts, so no phrase has more than a small share of the rows. Of candidates only the counts move.
    """
    levels = []
    with ExitStack() as held:
        level = held.enter_context(written(word_lists(docs)))
        counts, name = level.where("at is not null").select("at", "lang", "word", "n"), ("lang", "word")
        totals = cut_lineage(counts.groupBy("lang").agg(F.sum("n").alias("n")))
        while True:
            phrase = Window.partitionBy(*name)
            summed = counts.withColumns({"f": F.sum("n").over(phrase), "id": F.min("at").over(phrase)})
            found = held.enter_context(written(summed.where(F.col("f") >= p.least).drop("n")))
            levels.append(cut_lineage(found.where("at = id").drop("at")))
            if len(levels) == p.longest:
                return totals, levels
            with held.pop_all():  # a level's tables go as soon as the next one is written
                level = held.enter_context(written(frequent_lists(level, found.select("at", "id"), len(levels) > 1)))
            counts, name = longer_counts(level), ("prefix", "tail")


def _parts(levels: list[DataFrame]) -> Iterator[DataFrame]:
    """Per length (id, lang, phrase, a, firsts, lasts, prefix, tail): firsts[k] and lasts[k] are the occurrences of the first and the last k words."""
    none = F.lit(None).cast("bigint")
    before = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("f").alias("a"), F.array("f").alias("firsts"), F.array("f").alias("lasts"), none.alias("prefix"), none.alias("tail"))
    yield before
    for level in levels[1:]:
        rows = level.join(before.select(F.col("id").alias("prefix"), "lang", "phrase", "firsts"), "prefix")
        rows = rows.join(before.select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("word"), "lasts"), "tail")
        grown = lambda c: F.concat(c, F.array("f"))
        before = cut_lineage(rows.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.col("f").alias("a"), grown("firsts").alias("firsts"), grown("lasts").alias("lasts"), "prefix", "tail"))
        yield before


def _score(m: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase of m words, in exact decimals."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = [f"struct(({wide('a')} * {wide('n')} * 1000) div ({wide(f'firsts[{k - 1}]')} * {wide(f'lasts[{m - k - 1}]')}) as score, {k} as k, firsts[{k - 1}] as l, lasts[{m - k - 1}] as r)" for k in range(1, m)]
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def top_ranked(rows: DataFrame, key: str, order: list[Column], top: int, spread: str) -> DataFrame:
    """rows with rank, the first `top` of each key in that order: first in parts of about _RANKED rows, then of what the parts leave."""
    parts = -(-rows.count() // _RANKED)
    while parts > 1:
        within = Window.partitionBy(key, F.pmod(F.xxhash64(spread), F.lit(parts))).orderBy(*order)
        rows = cut_lineage(rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top).drop("rank"))
        parts = min(parts - 1, -(-rows.count() // _RANKED))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the highest-scoring phrases of each language of docs(lang, text), null being `und`.

    n are the language's words, a the phrase's occurrences within pieces; it is cut where floor(1000 a n / (l r)) is least, l
    and r being the occurrences of both parts. Null and empty texts have no words, a null lang counts as the language
    `und`, repeated rows count as often as they occur, other columns are ignored; an empty table gives no rows. Ties
    in score and a are broken by the phrase's bytes, so all ranks are fixed.
    """
    totals, levels = frequent_phrases(docs, p)
    found = list(_parts(levels))
    kept = []
    for m, rows in enumerate(found[1:], 2):
        rows = rows.join(totals, "lang").withColumn("cut", _score(m))
        if m < p.longest:  # what a longer phrase takes in, one that is one word longer takes in too
            sides = found[m].select(F.explode(F.array("prefix", "tail")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            rows = rows.join(sides, "id", "left").where(F.col("b").isNull() | (100 * F.col("b") < p.absorb * F.col("a")))
        kept.append(rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    every = kept[0]
    for rows in kept[1:]:
        every = every.unionByName(rows)
    ranked = top_ranked(cut_lineage(every), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], p.top, "phrase")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
q as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
t as (select lang, sum(len(ws))::bigint as n from q group by lang),
i as (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from q, (select unnest([1, 2, 3, 4, 5]) as m) where len(ws) >= m),
f as materialized (select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase, count(*) as f from i group by all having count(*) >= 100),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1),
k as (select *, unnest(range(1, m)) as k from c),
x as (select k.lang, k.phrase, k.a, k, l.f as l, r.f as r, n, (1000::hugeint * k.a * n) // (l.f::hugeint * r.f) as score from k join t using (lang)
  join f l on l.lang = k.lang and l.phrase = array_to_string(ws[1 : k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(ws[k + 1 : k.m], ' ')),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
s as (select lang, array_to_string(ws[i : i + j - 1], ' ') as phrase, max(a) as b from (select *, unnest(range(1, m - j + 2)) as i from (select *, unnest(range(2, m)) as j from c)) group by 1, 2),
o as (select b.* from b left join s using (lang, phrase) where s.b is null or 100 * s.b < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from o qualify rank <= 2000
"""
