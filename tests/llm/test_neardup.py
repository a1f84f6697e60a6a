import random
import re

import pytest
from pyspark.sql import functions as F

from vertexlens.llm import neardup
from vertexlens.llm.neardup import OP4_PARAMS as OP4
from vertexlens.llm.neardup import NearDupParams, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, p):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        s = {tuple(w[k : k + p.words]) for k in range(len(w) - p.words + 1)} if len(w) >= p.words else ({tuple(w)} if w else set())
        sets[i] = s
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= p.percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(r, size, words, edits):
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("p", [OP4, NearDupParams(), NearDupParams(words=3, percent=85, chunks=12, far=31, block=7, block_bytes=6000)])
def test_groups_equal_brute_force(docs_of, p):
    r = random.Random(11)
    texts = [None, "", "  ", "One two", "one  TWO", "one two three", "ONE TWO three", "solo"]
    for _ in range(12):
        texts += family(r, 12, r.randrange(20, 200), 8)
    texts += family(r, 60, 120, 14)
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    want = brute(rows, p)
    got = {x.doc_id: x for x in near_duplicates(docs_of(rows), p).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (i == x.component_id) for i, x in got.items())


def test_edge_rows(docs_of):
    assert near_duplicates(docs_of([]), OP4).count() == 0
    rows = docs_of([(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, None), (9, None)]).withColumn("sig", F.lit(1)).withColumn("set_a", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(rows, OP4).collect())
    assert got == [(0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]


def test_a_very_long_text(docs_of):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(9000)}" for _ in range(60_000))
    got = {x.doc_id: x.component_id for x in near_duplicates(docs_of([(1, long), (2, long + " tail"), (3, "w1 w2 w3")]), OP4).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_ids_may_be_null_or_name_several_texts(docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c + " end"), (None, b + " end"), (None, "x y z")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs_of(rows), OP4).collect())
    assert got == [(0, 0, True)] * 3 + [(0, 5, False), (3, 3, True), (5, 3, False), (5, 5, True)]


def test_pairs_within_the_guaranteed_distance_share_a_key(spark):
    r = random.Random(2)
    p = NearDupParams(chunks=4, width=3, errors=1)
    base = [r.randrange(1 << 16) for _ in range(p.symbols)]
    rows = []
    for k in range(200):  # as many wrong symbols as the pigeonhole allows, anywhere
        sig = list(base)
        for i in r.sample(range(p.symbols), p.chunks * (p.errors + 1) - 1):
            sig[i] ^= 1 + r.randrange(1 << 15)
        rows.append((k, bytearray(b"".join(x.to_bytes(2, "little") for x in sig))))
    rows.append((-1, bytearray(b"".join(x.to_bytes(2, "little") for x in base))))
    keys = {x.nid: set(x.k) for x in spark.createDataFrame(rows, "nid bigint, sig binary").select("nid", neardup.chunk_keys(p).alias("k")).collect()}
    assert len(keys[-1]) == p.chunks * p.width and all(keys[k] & keys[-1] for k in range(200))


def test_boilerplate_costs_no_comparison_of_all_with_all(docs_of, monkeypatch):
    """Texts that share a third of their shingles do not come together, and copies among them are found."""
    r = random.Random(3)
    shared = [f"b{i}" for i in range(90)]
    texts = [" ".join(shared + [f"u{k}_{i}" for i in range(90)]) for k in range(400)]
    texts += [texts[k] + " end" for k in range(0, 400, 20)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    sets = []
    monkeypatch.setattr(neardup, "shingle_sets", lambda df, p, own=neardup.shingle_sets: sets.append(df.count()) or own(df, p))
    got = {x.doc_id: x.component_id for x in near_duplicates(docs_of(rows), OP4).collect()}
    assert got == {i: i if i < 400 else (i - 400) * 20 for i in range(len(texts))}
    assert sets == [40]  # full sets are built for the copies alone
