"""Document measurements: one vectorised pass over whole texts, shared by the rules and the quality model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vertexlens.llm.frames import id_and_bytes
from vertexlens.llm.textbytes import IS_SPACE, Block, SpanHash, blocks, byte_table, grouped, owner, per_text, runs

#: Symbols that the rules count.
SYMBOLS = byte_table(b"#*$%&|<>")
_UPPER, _LOWERCASE, _DIGIT = byte_table(range(65, 91)), byte_table(range(97, 123)), byte_table(range(48, 58))
_PUNCT = byte_table(b"!?.,;:")
_BANG = byte_table(b"!?")
_STOP = byte_table(b".!?")
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True

MEASURES = (
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_same_as_last", "n_upper", "n_lower", "n_digits", "n_punct", "n_bang", "n_high", "n_stop_words_end", "n_short_words", "n_long_words",
)


def measure(b: Block) -> dict[str, np.ndarray]:
    """Per text of the block, whole texts throughout:

    n_words: runs outside [\\x20\\x09-\\x0D]; word_chars: code points in them; n_symbols: SYMBOLS anywhere;
    n_lines: \\n-split lines with a word; n_dup_lines: of those, equal to an earlier one of the text;
    n_repeat_words: words inside a 3-word window found twice or more in the text, the first included.
    """
    n = len(b.start)
    count = lambda at: np.bincount(at, minlength=n).astype(np.int64)
    space = IS_SPACE[b.buf]
    ws, we = runs(~space)
    h = SpanHash(b.buf)
    doc, word = owner(b, ws), h(ws, we)
    m = {"n_bytes": b.end - b.start, "n_words": count(doc), "word_chars": per_text(b, ~space & ~_CONT[b.buf])}
    for name, t in (("n_symbols", SYMBOLS), ("n_upper", _UPPER), ("n_lower", _LOWERCASE), ("n_digits", _DIGIT), ("n_punct", _PUNCT), ("n_bang", _BANG), ("n_high", _HIGH)):
        m[name] = per_text(b, t[b.buf])

    # The newline after each text ends its last line, so no line spans two texts.
    le = np.flatnonzero(b.buf == 10)
    ls = np.concatenate([[0], le[:-1] + 1])
    words_before = np.searchsorted(ws, np.concatenate([ls, [len(b.buf)]]))
    full = words_before[1:] > words_before[:-1]
    ls, le = ls[full], le[full]
    line_doc = owner(b, ls)
    first = np.unique(grouped(line_doc, h(ls, le)), return_index=True)[1]
    m["n_lines"] = count(line_doc)
    m["n_dup_lines"] = m["n_lines"] - count(line_doc[first])

    m["n_distinct_words"] = count(doc[np.unique(grouped(doc, word), return_index=True)[1]])
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (word[1:] == word[:-1]))
    m["n_same_as_last"] = count(doc[same])
    covered = np.zeros(len(ws), bool)
    tri = np.flatnonzero(doc[2:] == doc[:-2])
    if len(tri):
        key = grouped(doc[tri], (word[tri] * np.uint64(3) + word[tri + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + word[tri + 2] * np.uint64(0x165667B19E3779F9))
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        again = tri[times[at] > 1]
        for k in range(3):
            covered[again + k] = True
    m["n_repeat_words"] = count(doc[covered])
    m["n_stop_words_end"] = count(doc[_STOP[b.buf[we - 1]]]) if len(ws) else np.zeros(n, np.int64)
    m["n_short_words"] = count(doc[we - ws <= 3])
    m["n_long_words"] = count(doc[we - ws >= 16])
    return m


def measured(docs: DataFrame, names: tuple[str, ...] = MEASURES, text: str = "text") -> DataFrame:
    """doc_id and the named measures (bigint) of every row; a null text counts as empty (all zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for b in blocks(batch.column(1)):
                m = measure(b)
                yield pa.RecordBatch.from_arrays([ids[b.first : b.last], *(pa.array(m[k], pa.int64()) for k in names)], ["doc_id", *names])

    return id_and_bytes(docs, text).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names))
