import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vertexlens.llm.decontam import DecontamParams, leaks
from vertexlens.llm.repeats import RepeatParams, corpus_order, remove_repeats, repeated_windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute_leaks(text, items, window=13):
    w, hit, found = words_of(text), set(), set()
    for k, t in items:
        x = words_of(t)
        n = min(window, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [400_000, 40])
def test_leaks_equal_brute_force(spark, docs_of, block):
    r = random.Random(8)
    word = lambda: r.choice("alpha beta gamma delta é 日本 x1".split())
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 30, 40, 40])] + [(50, None), (51, "!!"), (52, "Alpha, BETA.")]
    items.append((60, items[7][1]))
    texts = [None, "", "...", "alpha"]
    for _ in range(60):
        t = [f"u{r.randrange(9)}" if r.random() < 0.1 else word() for _ in range(r.randrange(1, 60))]
        if r.random() < 0.5:
            x = (r.choice(items[3:9])[1]).split()
            a = r.randrange(len(x))
            t[3:3] = x[a : a + r.randrange(1, 30)]
        texts.append(r.choice([" ", ", ", "-"]).join(t))
    docs = docs_of(list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # one-word items hit nearly everything: test with and without them
    for use in (items, [x for x in items if x[0] > 2]):
        got = {x.doc_id: x for x in leaks(docs, bench.where(F.col("item_id").isin([k for k, _ in use])), DecontamParams(block_words=block)).collect()}
        for i, t in enumerate(texts):
            g = got[i]
            assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == brute_leaks(t, use), (i, t)
            assert sum(s.z - s.a for s in g.spans) == g.n_hit


def test_leaks_without_items_or_rows(spark, docs_of):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = leaks(docs_of([(1, "a b"), (1, "a b"), (None, None)]).withColumn("spans", F.lit(1)), bench).collect()
    assert len(got) == 3 and not any(r.contaminated for r in got)
    assert leaks(docs_of([]), bench).count() == 0


def brute_removal(texts, w):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - w + 1):
            seen.setdefault(b[i : i + w], []).append((d, i))
    cover = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i : i + w] = b"\x01" * w
    out = []
    for b, c in zip(data, cover):
        kept = bytes(x for x, y in zip(b, c) if not y)
        runs = sum(1 for i, y in enumerate(c) if y and (i == 0 or not c[i - 1]))
        out.append((len(b), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(r):
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60), prose(45), prose(200)]
    line = prose(14)
    texts = [None, "", "short", "z" * 199, "z" * 199, "y" * 700, "ab" * 400, "xyz" * 300 + prose(30)]
    for i in range(70):
        parts = [prose(r.randrange(1, 60)), r.choice(shared), prose(r.randrange(1, 60))]
        if i % 3 == 0:
            parts = [line] * 3 + parts + [line]
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21], texts[20] + "!"]
    for i in range(10):
        t = list(texts[30])
        t[r.randrange(len(t))] = "Q"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("p", [RepeatParams(), RepeatParams(group=1), RepeatParams(window=60, gram=16, group=3, cell=8)])
def test_removal_equals_brute_force(docs_of, p):
    texts = repeated_texts(random.Random(5))
    got = {r.doc_id: r for r in remove_repeats(docs_of(list(enumerate(texts))), p).collect()}
    want = brute_removal(texts, p.window)
    for i in range(len(texts)):
        g = got[i]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[i], (i, texts[i])
    assert got[0].kept_text is None and got[1].kept_text == "" and got[5].kept_text == ""


def test_removal_of_odd_rows(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
    rows = docs_of([(1, "q" * 150), (1, "q" * 150), (None, "r" * 300), (None, None)]).withColumn("key", F.lit(1)).withColumn("body", F.lit(2))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(rows).collect())
    assert got == [(0, 0, 0), (0, 300, 300), (1, 150, 0), (1, 150, 0)]
    twice = remove_repeats(docs_of([(1, "a unique passage " + "".join(map(str, range(200)))), (1, "a unique passage " + "".join(map(str, range(200))))])).collect()
    assert all(r.n_removed == r.n_bytes for r in twice)


def test_long_text_is_cut_into_pieces(docs_of):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))
    passage = prose(80)
    long = prose(90_000) + passage + prose(20_000)
    got = {x.doc_id: x.n_removed for x in remove_repeats(docs_of([(1, long), (2, passage), (3, prose(50))])).collect()}
    assert got == {1: len(passage), 2: len(passage), 3: 0}


def test_suffix_ranks():
    assert [f.tolist() for f in repeated_windows([b"abcdefghij", b"xxbcdefghi", b""], 8)] == [[False, True, False], [False, False, True], []]


def test_corpus_order_is_the_order_of_suffixes():
    r = random.Random(6)
    word = lambda: bytes(r.choice(b"ab\x00\xff") for _ in range(r.randrange(0, 400)))
    base = [word() for _ in range(6)]
    parts = [b"", *(b"".join(r.choice(base) for _ in range(3)) for _ in range(12)), b"a" * 900, b"ab" * 300, b"\x00" * 50, b""]
    order, first = corpus_order(parts)
    ends = [a + len(x) for a, x in zip(first, parts)]
    text = b"".join(parts)
    owner = [next(k for k, z in enumerate(ends) if i < z) for i in range(len(text))]
    suffixes = [text[i : ends[owner[i]]] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(text))) and suffixes == sorted(suffixes)


@pytest.mark.parametrize("window", [8, 20, 200])
def test_windows_of_strange_bytes(window):
    r = random.Random(window)
    tm = "a"
    while len(tm) < 4096:
        tm += tm.translate(str.maketrans("ab", "ba"))
    base = [bytes(r.choice(b"ab\x00\n") for _ in range(r.randrange(1, 300))) for _ in range(5)]
    parts = [tm.encode()[:600], tm.encode()[1024:1700], *(b"".join(r.choice(base) for _ in range(4)) for _ in range(20)), b"z" * 300, b""]
    seen = {}
    for k, x in enumerate(parts):
        for i in range(len(x) - window + 1):
            seen.setdefault(x[i : i + window], []).append((k, i))
    want = [[False] * max(0, len(x) - window + 1) for x in parts]
    for at in seen.values():
        for k, i in at:
            want[k][i] = len(at) > 1
    assert [f.tolist() for f in repeated_windows(parts, window)] == want


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n]


def test_removal_from_texts_that_cancel_in_polynomials(docs_of):
    t = thue_morse(8192)
    flip = t.translate(str.maketrans("ab", "ba"))
    texts = [t[:1024] + "1" * 50 + flip[:1024], flip[:2048] + "2" * 60 + t[:4096], t, "x" + flip]
    got = {r.doc_id: r for r in remove_repeats(docs_of(list(enumerate(texts)))).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(4)] == brute_removal(texts, 200)


@pytest.mark.parametrize("block", [30, 10**6])
def test_long_items_are_cut_without_losing_a_window(docs_of, spark, block):
    r = random.Random(12)
    long = [f"w{r.randrange(500)}" for _ in range(400)]
    items = [(1, " ".join(long)), (2, "short one"), (1, " ".join(long[::-1]))] + [(3, "again and again " * 10)] * 30
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("automaton", F.lit("x"))
    texts = [" ".join(long[i : i + 13]) + " zz" * k for i, k in ((0, 3), (17, 0), (18, 400), (387, 2))]
    texts += ["a short one there " * 20_000, " ".join(long[5:17]), " ".join(long)]
    for x in leaks(docs_of(list(enumerate(texts))), bench, DecontamParams(block_words=block)).collect():
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute_leaks(texts[x.doc_id], items), x.doc_id


def test_items_without_id_hit_but_have_no_name(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, text), (2, "w0 w1 other"), (3, None)])
    for items, named in (([(None, text)], []), ([(None, text), (None, text)], []), ([(None, text), (7, text)], ["7"])):
        rows = {r.doc_id: r for r in leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
        assert (rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (20, len(named), True)
        assert rows[1].items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert rows[2].n_hit == 0 and rows[3].n_words == 0
