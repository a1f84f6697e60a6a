import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vertexlens.llm.neardup import NearDupParams, near_duplicates
from vertexlens.llm.rules import BASE, POLICIES, RULES, ablations, apply_policy, bits, ledger
from vertexlens.llm.tokens import load_spec, text_counter, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    tri = {}
    for i in range(len(ws) - 2):
        tri.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + k for at in tri.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def odd_texts():
    r = random.Random(2)
    alphabet = ["a", "b", "é", "日", " ", " ", "\n", "\t", "#", "\x0b", "\x85", " ", "A"]
    return [None, "", " \n ", "one", "a b", "x\n\nx\nx", *("".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(60)), "ab cd ef " * 40_000]


def test_measures_against_brute_force(docs_of):
    texts = odd_texts()
    got = {r.doc_id: r for r in ledger(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)[:80]


@pytest.mark.parametrize("n", [512, 1024, 8192])
def test_lines_and_words_that_cancel_in_polynomials(docs_of, n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    flip = t.translate(str.maketrans("ab", "ba"))
    texts = [t + "\n" + flip, f"{t} {flip} {t}\n{flip} {t} {flip}\n{t} {flip} {t}"]
    for r in ledger(docs_of(list(enumerate(texts)))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
    groups = near_duplicates(docs_of([(1, f"{t} x y z"), (2, f"{flip} x y z"), (3, f"{t} x y z")]), NearDupParams()).collect()
    assert {r.doc_id: r.component_id for r in groups} == {1: 1, 2: 2, 3: 1}


def test_policies_and_ablations(docs_of):
    good = " ".join(f"word{i} thing" for i in range(60))
    rows = ledger(docs_of([(1, good), (2, "short"), (3, good + " ###" * 80), (4, "la la la " * 60), (5, None)]))
    kept = {r.doc_id: r.kept for r in apply_policy(rows, POLICIES["2024-1"]).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.doc_id: r.kept for r in apply_policy(rows, POLICIES["2024-2"]).collect()}[3]
    assert {r.doc_id: r.kept for r in apply_policy(rows, BASE).collect()}[3]
    table = {r.rule: (r.n_failed, r.n_only) for r in ablations(rows, POLICIES["2024-1"]).collect()}
    assert set(table) == set(RULES) and table["too_few_words"] == (2, 2) and table["symbols"] == (1, 1)
    assert bits("too_few_words", "symbols") == 0b101


def test_empty_table_and_clashing_columns(docs_of):
    empty = docs_of([])
    assert ledger(empty).count() == 0 and [r.n_failed for r in ablations(ledger(empty), BASE).collect()] == [0] * len(RULES)
    clash = docs_of([(1, "a b c"), (1, "a b c"), (None, "x")]).withColumn("n_words", F.lit("z")).withColumn("failed", F.lit("z")).withColumn("body", F.lit(1))
    assert sorted(r.n_words for r in ledger(clash).collect()) == [1, 3, 3]
    assert sorted(r.n_tokens for r in token_counts(clash, PATH).collect()) == [1, 3, 3]


def test_counts_equal_the_library():
    count, library = text_counter(load_spec(PATH)), Tokenizer.from_file(PATH)
    r = random.Random(4)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|x|>", "ΣΑΣ ΟΔΟΣ", "İstanbul", "don't we're I'M 'S", "1234½Ⅷ", "日本語 😀😀", "a" * 3000, "ﬁ ǅ\x85x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x250), r.randrange(0x3B1, 0x3CA), 32])) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_rows(docs_of):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs_of([(1, None), (2, ""), (3, "é a")]), PATH).collect()}
    assert got[1] == got[2] == (0, 0) and got[3] == (4, 2)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        load_spec(public_tokenizers.path("byte_bpe_50k.json"))


def test_any_special_string_counts_one():
    """Special strings are looked for by the tokenizer's own list, whatever they look like."""
    tok = Tokenizer.from_file(PATH)
    tok.add_special_tokens(["[SEP]", "@@"])
    spec = load_spec(PATH)
    count = text_counter(spec | {"special": [*spec["special"], "[SEP]", "@@"]})
    for text in ("a [SEP] b", "[SEP]", "@@x@@[SEP]", "no special", "a<|endoftext|>b [sep]", "[SE P] @ @"):
        assert count(text) == len(tok.encode(text, add_special_tokens=False).ids), text
