"""Language identification by compression.

Each language is a raw-content zstandard dictionary cut from a bounded sample of labelled documents. A text
is compressed, block by block and to its end, once with every dictionary; the language whose dictionary
gives the fewest bytes wins. A narrow margin over the runner-up is a rejection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import bounded_batches, crc_mod, table

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters says nothing of the language; A-Z are lower-cased beforehand.
_LETTERS = bytes(c if c >= 128 or 97 <= c < 123 else 32 for c in range(256))
#: zstandard cannot use a dictionary shorter than this.
_LEAST = 16


@dataclass(frozen=True)
class LangIdParams:
    """sample_docs x piece_chars bounds what is learned per language, of which any number may be: a model is about 120 KB for each.

    Languages without a letter in their sample are not learned.
    block: bytes compressed at a time, so that the dictionary weighs as much at a long text's end as at its start.
    level: compression level, the same for every text.
    margin: least share of the winner's bytes by which the runner-up must be longer, else the text is rejected.
    """

    sample_docs: int = 200
    piece_chars: int = 600
    block: int = 2048
    level: int = 12
    margin: float = 0.003


def learn(docs: DataFrame, learnable: Column, params: LangIdParams = LangIdParams()) -> dict[str, bytes]:
    """lang -> dictionary, from the rows where `learnable` holds and lang and text are not null.

    Which documents are sampled follows a hash of doc_id, so it does not depend on order or partitions; the hash
    bound is set per language from its count. An id counts once, with the least of its texts, hence a bounded number of
    pieces reaches the driver, however often rows are repeated. Rows without an id are not learned from.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row per language
    if not counts:
        return {}
    place = (F.xxhash64("doc_id", F.lit(7)) / F.lit(2.0**64)) + 0.5
    near = None
    for r in counts:
        bound = min(1.0, 2 * params.sample_docs / r["n"])
        near = F.when(F.col("lang") == r["lang"], bound) if near is None else near.when(F.col("lang") == r["lang"], bound)
    last = F.greatest(F.lit(1), F.length("text") - params.piece_chars)
    piece = F.substring(F.col("text"), 1 + F.pmod(F.xxhash64("doc_id", F.lit(8)), last).cast("int"), F.lit(params.piece_chars))
    sample = rows.where(place <= near).groupBy("lang", "doc_id").agg(F.min(F.struct(place.alias("at"), piece.alias("piece"))).alias("one"))
    sample = sample.select("lang", "one.at", "doc_id", "one.piece").collect()
    pieces: dict[str, list[tuple]] = {}
    for r in sample:
        pieces.setdefault(r["lang"], []).append((r["at"], r["doc_id"], r["piece"]))
    found = {}
    for lang in (r["lang"] for r in counts if r["lang"] in pieces):
        body = "\n".join(p for _, _, p in sorted(pieces[lang])[: params.sample_docs])
        if _LETTER.search(body):
            found[lang] = prepared(body).ljust(_LEAST)
    return found


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_LETTERS) + b" "


class Compressors:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], params: LangIdParams):
        self.langs, self.params = list(dictionaries), params
        self.compress = [self._compressor(body, params.level) for body in dictionaries.values()]
        self.frame = [len(c(b"")) for c in self.compress]

    @staticmethod
    def _compressor(body: bytes, level: int):
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str) -> list[int]:
        """Bytes per language, framing aside, so that a text that begins another block is not longer for it."""
        data, step = prepared(text), self.params.block
        parts = [data[a : a + step] for a in range(0, len(data), step)]
        return [max(1, sum(len(c(p)) for p in parts) - frame * len(parts)) for c, frame in zip(self.compress, self.frame)]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): `und`, 0, 0 without a letter or without languages; a tie goes to the language with more labelled rows.

        score: softmax over the sizes, 4 bytes less being as likely again; margin: runner-up less winner over the winner.
        """
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0
        s = self.sizes(text)
        best = min(range(len(s)), key=s.__getitem__)
        rest = s[:best] + s[best + 1 :]
        score = 1 / sum(math.exp2(-min(1000, (x - s[best]) / 4)) for x in s)
        return self.langs[best], score, (min(rest) - s[best]) / s[best] if rest else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], params: LangIdParams = LangIdParams()) -> DataFrame:
    """All columns of docs and lang_pred, lang_score, lang_accepted, for every row and whole texts.

    Null, empty and letterless texts get `und` and are rejected. Existing columns of those names are replaced. Repeated rows
    stay repeated; an empty table gives no rows. A text of any length is classified by all of it, in the same way.
    """
    out = ("lang_pred", "lang_score", "lang_accepted")
    docs = bounded_batches(docs).drop(*out)
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x sample_docs x piece_chars
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(model.value, params)
        for batch in batches:
            got = [c.classify(t) for t in batch.column(names.index("text")).to_pylist()]
            lang, score, margin = zip(*got) if got else ((), (), ())
            ok = [x != "und" and m >= params.margin for x, m in zip(lang, margin)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [*names, *out])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, nor is its row learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    dictionaries = learn(docs, ~held_out)
    return classify(docs.select("doc_id", "text"), dictionaries).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_accepted")
