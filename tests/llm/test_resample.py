import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from vertexlens.llm import resample as rs
from vertexlens.llm.resample import ResampleParams, resample


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, order):
    ws = words(text)
    return [" ".join(ws[i : i + m]) for m in range(1, order + 1) for i in range(len(ws) - m + 1)]


def brute(docs, target, p):
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, p.order)))
    for _, text in target:
        t.update(map(bucket, features(text, p.order)))
    S, T = s.total(), t.total()
    out = []
    for i, text in docs:
        fs = features(text, p.order)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets)))) for b in map(bucket, fs))
        weight = gain // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= p.least_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(able[: p.percent * len(able) // 100], 1):
        ranks.setdefault(r[:4], []).append(place)
    rows = []
    for r in out:
        left = ranks.get(r[:4])
        rows.append((*r[:4], left.pop(0) if left else None))
    return rows


def some_docs():
    r = random.Random(3)
    vocab = ["alpha", "Beta", "GAMMA", "d1", "é", "日本", "x", "Ünder"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .. "), (203, "a" * 5000), (None, None), (None, text(30)), (None, text(25)), (204, "x " * 30_000)]
    docs += [docs[3], docs[3], (300, docs[4][1]), (5, text(40))]
    return docs


@pytest.mark.parametrize("p", [ResampleParams(percent=40), ResampleParams(order=3, buckets=97, percent=50, least_words=5)])
def test_against_brute_force(docs_of, p):
    docs = some_docs()
    target = [(i, t) for i, t in docs[::7]] + [(None, None), (9, "new words ü")]
    got = sorted(map(tuple, resample(docs_of(docs), docs_of(target), p).collect()), key=repr)
    assert got == sorted(brute(docs, target, p), key=repr)
    assert any(r[4] for r in got)


def test_copies_are_ranked_in_a_row_and_split(docs_of, monkeypatch):
    monkeypatch.setattr(rs, "_COPIES", 3)
    p = ResampleParams(percent=100, least_words=2)
    docs = [(1, "some words here")] * 10 + [(2, "other words")] * 2 + [(3, "one")]
    got = sorted(map(tuple, resample(docs_of(docs), docs_of([(0, "words")]), p).collect()), key=repr)
    assert got == sorted(brute(docs, [(0, "words")], p), key=repr)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 13))


def test_empty_tables(docs_of):
    assert resample(docs_of([]), docs_of([(1, "a")])).collect() == []
    docs = [(1, "a b c"), (2, None)]
    p = ResampleParams(percent=100, least_words=1)
    assert sorted(map(tuple, resample(docs_of(docs), docs_of([]), p).collect())) == sorted(brute(docs, [], p))


def test_features_grow_with_words():
    p = ResampleParams(order=3)
    assert [p.features(w) for w in range(5)] == [0, 1, 3, 6, 9]
