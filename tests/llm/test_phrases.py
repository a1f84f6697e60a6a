import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vertexlens.llm import phrases as ph
from vertexlens.llm.phrases import PhraseParams, collocations, positions


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, p):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for m in range(1, p.longest + 1):
                f.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    out = {}
    for (lang, ws), a in cands.items():
        inside = (b for (other, longer), b in cands.items() if other == lang and len(longer) > len(ws) and any(longer[i : i + len(ws)] == ws for i in range(len(longer))))
        if any(100 * b >= p.absorb * a for b in inside):
            continue
        score, _, le, r = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((" ".join(ws), a, le, r, n[lang], score))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows += [(lang, i, *r) for i, r in enumerate(found[: p.top], 1)]
    return sorted(rows)


def some_docs(n, seed):
    r = random.Random(seed)
    vocab = ["the", "of", "New", "york", "CITY", "é", "日本", "a-b", "x\x00y", "\xa0z"]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(k))
    docs = [(text(r.randrange(0, 40)), r.choice(["en", "en", "fr", None])) for _ in range(n)]
    docs += [(None, "en"), ("", None), (" .. ", "en"), ("in the middle of nowhere " * 7, "en"), ("a " * 500, "de"), ("new york city " * 2000, "fr")]
    return docs + [docs[0]] * 9


@pytest.mark.parametrize(("p", "block"), [(PhraseParams(least=6), 16 << 20), (PhraseParams(longest=4, least=3, top=7, absorb=80), 300), (PhraseParams(longest=2, least=2), 1)])
def test_against_brute_force(spark, monkeypatch, p, block):
    monkeypatch.setattr(ph, "_BLOCK_BYTES", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    docs = some_docs(90, p.longest)
    df = spark.createDataFrame([(t, la, 1, "x") for t, la in docs], "text string, lang string, n int, phrase string").repartition(3)
    try:
        got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(df, p).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs, p)
    assert got


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(4 * 10**12, 9 * 10**14, [5 * 10**12], [6 * 10**12])], "a bigint, n bigint, firsts array<bigint>, lasts array<bigint>")
    cut = rows.select(ph._score(2).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == (1000 * 4 * 10**12 * 9 * 10**14 // (5 * 10**12 * 6 * 10**12), 1, 5 * 10**12, 6 * 10**12)


def test_ranks_in_parts_equal_ranks_at_once(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"), (F.col("id") % 50).alias("score"), F.col("id").cast("string").alias("phrase"))
    order = [F.desc("score"), F.asc("phrase")]
    whole = sorted(map(tuple, ph.top_ranked(rows, "lang", order, 25, "phrase").collect()))
    monkeypatch.setattr(ph, "_RANKED", 200)
    assert sorted(map(tuple, ph.top_ranked(rows, "lang", order, 25, "phrase").collect())) == whole
    assert len(whole) == 50


def test_empty_table_and_one_word(spark):
    kind = "text string, lang string"
    assert collocations(spark.createDataFrame([], kind)).collect() == []
    assert collocations(spark.createDataFrame([("word.word", "en")], kind), PhraseParams(least=1)).collect() == []


def test_positions_break_at_pieces():
    import pyarrow as pa

    word, text, pos = positions(pa.array([b"A b.c", None, b"", b"d\te"]))
    assert word.to_pylist() == ["a", "b", "c", "d", "e"] and text.tolist() == [0, 0, 0, 3, 3]
    assert [b - a == 1 for a, b in zip(pos, pos[1:])] == [True, False, False, True]
