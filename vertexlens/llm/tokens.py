"""Token counts by byte-pair merging, without ever naming a token.

A pre-token's symbols form a doubly linked list; the adjacent pairs that have a merge rank wait in a heap.
The lowest-ranked pair is merged until none is left: the count is the initial symbols less the merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import bounded_batches, table

#: Pre-tokens whose counts a worker remembers; the memory is dropped and begun anew beyond it. Longer ones are not remembered.
MEMO = 400_000
MEMO_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """pre-token -> number of tokens; computed on first sight, remembered while the memo lasts."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        super().__init__()
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        stand_in = byte_symbols()
        self.inner = [number(s) for s in stand_in]
        self.final = [number(s + suffix) for s in stand_in]
        self.rank = {(number(a), number(b)): (i, number(a + b)) for i, (a, b) in enumerate(merges)}

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n

    def merged(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        rank = self.rank
        sym = [self.inner[b] for b in data]
        sym[-1] = self.final[data[-1]]
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            left -= 1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                if r := rank.get((new, sym[k])):
                    heapq.heappush(heap, (*r, i, new, sym[k]))
            if (p := prv[i]) >= 0 and (r := rank.get((sym[p], new))):
                heapq.heappush(heap, (*r, p, sym[p], new))
        return left


def load_spec(path: str) -> dict:
    """What counting needs of a tokenizer file; about 1 MB, so it travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    known = model["type"] == "BPE" and split.get("type") == "Split" and split["invert"] and steps == ["NFC", "Replace", "Lowercase"]
    if not known or model["continuing_subword_prefix"] or model["ignore_merges"]:
        raise ValueError(f"{path}: only byte-level BPE over NFC, lower-cased text with a pattern of the pre-tokens is supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = [t["content"] for t in spec["added_tokens"]]
    return {"merges": merges, "suffix": model["end_of_word_suffix"] or "", "pattern": split["pattern"]["Regex"], "special": special}


def text_counter(spec: dict) -> Callable[[str], int]:
    """The function text -> tokens: special strings count one each, the rest is NFC, lower-cased and split by the pattern."""
    counts = MergeCounter(spec["merges"], spec["suffix"])
    words = regex.compile(spec["pattern"])
    special = regex.compile("|".join(map(regex.escape, spec["special"]))) if spec["special"] else None

    def plain(text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is by character, without final sigma
        return sum(map(counts.__getitem__, words.findall(text.lower())))

    def count(text: str) -> int:
        if not any(map(text.__contains__, spec["special"])):
            return plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(plain, parts))

    return count


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row's whole text; a null text is empty and has 0 of each.

    Rows stay as they are repeated; other columns are ignored. The file `tokenizer` is read on the driver only.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer))  # its size is that of a vocabulary, not of the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(spec.value)
        for batch in batches:
            n = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return bounded_batches(docs).select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(table(spark, sf_dir, "documents"), tokenizer).withColumn("over_limit", F.col("n_tokens") > 2048)
