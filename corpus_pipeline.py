"""A corpus pipeline of five stages, each over all that the stage before it kept.

language ID -> near-duplicates -> repeated passages -> decontamination -> packing. run() applies the stages to
`documents`, each written as a table in the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.decontam import leaks
from vertexlens.llm.frames import broadcast_if_small, crc_mod, cut_lineage, table
from vertexlens.llm.langid import classify, learn
from vertexlens.llm.neardup import NearDupParams, near_duplicate_groups, row_keys
from vertexlens.llm.packing import packed, word_lengths
from vertexlens.llm.repeats import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; `lang` becomes the told language."""
    told = classify(docs.select(*COLUMNS), learn(docs, crc_mod("doc_id", 3) != 1))
    return told.where("lang_accepted").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 80 %): that of least doc_id, null last. Texts without words stay.

    Null and repeated ids are allowed: rows are told apart by id and text. Rows alike in both are one; of their other
    columns the least are kept. Rows without id and words are all kept.
    """
    found = cut_lineage(near_duplicate_groups(docs, NearDupParams()))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    best = found.where("nid is not null").groupBy("nid").agg(F.min(key).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("nid", "best")
    grouped = found.join(best, "nid").select("k1", "k2", ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("stays"))
    blank = found.where("nid is null and doc_id is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", F.lit(True).alias("stays"))
    marked = cut_lineage(grouped.unionByName(blank).distinct())  # the rows of which there are others
    rows = docs.select(*COLUMNS, *row_keys())
    alone = rows.join(broadcast_if_small(marked.select("k1", "k2")), ["k1", "k2"], "left_anti")
    one = rows.join(broadcast_if_small(marked.where("stays").select("k1", "k2")), ["k1", "k2"], "left_semi")
    one = one.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return alone.select(*COLUMNS).unionByName(one.select("doc_id", "text", "rest.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur again anywhere; texts of which nothing is left stay, empty."""
    left = remove_repeats(docs, keep=("lang", "source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    told = leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return told.where("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed piece of the documents left."""
    return packed(word_lengths(docs))


STAGES = [("language ID", language_id), ("near-duplicates", near_dedup), ("repeated passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

#: Compression sizes are not SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
