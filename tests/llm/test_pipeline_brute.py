"""Each stage of the pipeline against a plain version of what it says, and the whole on empty and odd tables."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from vertexlens.llm import langid
from vertexlens.llm.tokens import load_spec, text_counter, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOUNDS = {"en": ["the", "ing", "ou", "sh"], "es": ["cion", "ez", "ña", "qu"]}
TABLE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def prose(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def corpus():
    r = random.Random(14)
    rows = [(i, prose(r, lang, r.randrange(30, 150)), lang) for i, lang in enumerate(["en", "es"] * 50)]
    item, passage = prose(r, "en", 20), prose(r, "es", 70)
    for k in range(12):  # near copies, exact copies, contaminated texts, passages
        words = rows[k][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((len(rows), " ".join(words), rows[k][2]))
        rows.append((len(rows), rows[20 + k][1], rows[20 + k][2]))
        rows.append((len(rows), prose(r, "en", 25) + " " + " ".join(item.split()[k % 5 : k % 5 + 10 + k % 6]) + " " + prose(r, "en", 5), "en"))
        rows.append((len(rows), prose(r, "es", 30) + " " + passage + " " + prose(r, "es", 30), "es"))
    rows += [(len(rows), "", "en"), (len(rows) + 1, None, "es"), (len(rows) + 2, "... 12", None)]
    r.shuffle(rows)
    return rows, item


def folder_of(path, rows, items):
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full) if full else [[]] * 5, TABLE)], schema=TABLE), path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([k for k, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), path / "benchmark.parquet")
    return str(path)


def one_of_each_group(rows):
    shingles = {}
    for i, t, _ in rows:
        w = WORD.findall(t.lower())
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in shingles}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in shingles:
        for b in shingles:
            both = len(shingles[a] & shingles[b])
            if a < b and both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def without_repeats(rows):
    seen = {}
    for i, t, _ in rows:
        b = t.encode()
        for k in range(len(b) - 199):
            seen.setdefault(b[k : k + 200], []).append((i, k))
    gone = {i: set() for i, *_ in rows}
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + 200))
    return [(i, bytes(x for k, x in enumerate(t.encode()) if k not in gone[i]).decode("utf-8", "ignore"), lang) for i, t, lang in rows]


def clean(rows, items):
    windows = set()
    for _, t in items:
        w = ITEM_WORD.findall(t.lower())
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    out = []
    for i, t, lang in rows:
        w = ITEM_WORD.findall(t.lower())
        hit = {j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t, lang))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang) for r in df.collect())


def test_stages_equal_their_plain_versions(spark, tmp_path):
    rows, item = corpus()
    sf = folder_of(tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = corpus_pipeline.language_id(spark, docs, sf)
    c = langid.Compressors(langid.learn(docs, corpus_pipeline.crc_mod("doc_id", 3) != 1), langid.LangIdParams())
    now = [(i, t, c.classify(t)[0]) for i, t, _ in rows if c.classify(t)[0] != "und" and c.classify(t)[2] >= langid.LangIdParams().margin]
    assert rows_of(told) == sorted(now) and len(now) >= 145
    told = spark.createDataFrame(told.collect(), docs.schema)
    unique = corpus_pipeline.near_dedup(spark, told, sf)
    now = one_of_each_group(now)
    assert rows_of(unique) == sorted(now) and len(now) < 130
    unique = spark.createDataFrame(unique.collect(), docs.schema)
    cut = corpus_pipeline.repeated_passages(spark, unique, sf)
    now = without_repeats(now)
    assert rows_of(cut) == sorted(now)
    cut = spark.createDataFrame(cut.collect(), docs.schema)
    kept = corpus_pipeline.decontamination(spark, cut, sf)
    before, now = len(now), clean(now, [(1, item)])
    assert rows_of(kept) == sorted(now) and before - 12 <= len(now) < before
    packed = corpus_pipeline.packing(spark, spark.createDataFrame(kept.collect(), docs.schema), sf).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: (len(WORD.findall(t)) + 1 if WORD.search(t) else 0) for i, t, _ in now}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed))


@pytest.mark.parametrize("items", [[], [(1, "an item of a few words")]])
def test_empty_table(spark, tmp_path, items):
    assert corpus_pipeline.run(spark, folder_of(tmp_path, [], items)).count() == 0


def test_very_long_texts_and_repeated_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, prose(r, lang, 60), lang) for i, lang in enumerate(["en", "es"] * 20)]
    long = prose(r, "en", 150_000)
    rows += [(100, long, "en"), (101, long + " end", "en"), (102, prose(r, "es", 100_000), "es"), *[(103, prose(random.Random(8), "es", 40), "es")] * 30]
    got = corpus_pipeline.run(spark, folder_of(tmp_path, rows, [(1, "some other words")])).collect()
    total = {}
    for x in got:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
    assert total[100] == 150_001 and 101 not in total and total[102] == 100_001 and total[103] == 41 and len(total) == 43


def test_token_counts_of_odd_tables(docs_of):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts(docs_of([]), path).count() == 0
    count = text_counter(load_spec(path))
    long = "a very long text " * 30_000 + "x" * 500
    rows = [(1, long), (1, long), (None, "two words"), (None, None), (2, ""), (1, "other")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs_of(rows), path).collect())
    assert got == sorted((i or 0, len((t or "").encode()), count(t or "")) for i, t in rows)
