"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; what is stored is the failure bits and the measurements.
A policy is a versioned set of bits, applied afterwards by integer arithmetic, so changing a policy or
asking what a rule costs never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.llm.frames import table
from vertexlens.llm.stats import measured

#: name -> SQL condition under which the rule fails. A rule's bit is its place here: only ever append.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines and n_dup_lines > 2",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "upper_case": "2 * n_upper > n_upper + n_lower and n_upper > 20",
}
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


def bits(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of `hard` and at most `allowed` of `soft`."""

    version: str
    hard: int
    soft: int = 0
    allowed: int = 0

    def keeps(self, failed: Column) -> Column:
        ok = failed.bitwiseAND(F.lit(self.hard)) == 0
        return ok & (F.bit_count(failed.bitwiseAND(F.lit(self.soft))) <= self.allowed) if self.soft else ok


BASE = Policy("base", bits("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("2024-1", BASE.hard | bits("symbols", "duplicate_lines", "word_length", "upper_case")), Policy("2024-2", BASE.hard, bits("symbols", "duplicate_lines", "word_length", "upper_case"), 1))}


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, measurements, failed bigint (bit i: rule i failed).

    Null and empty texts measure zero throughout and so fail too_few_words only. Repeated rows stay
    repeated; columns other than doc_id and text are ignored, whatever their names.
    """
    failed = F.lit(0).cast("bigint")
    for i, condition in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, MEASURED).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumn("kept", policy.keeps(F.col("failed")))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_only (failed by no other rule of the policy: kept if the rule were dropped), for each rule.

    A single aggregation over the ledger's bits; with no rows the counts are 0.
    """
    used = F.col("failed").bitwiseAND(F.lit(policy.hard | policy.soft))
    names = list(RULES)
    sums = [F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0, 1)), F.lit(0)).alias(f"f{i}") for i in range(len(names))]
    only = [F.coalesce(F.sum(F.when(used == (1 << i), 1)), F.lit(0)).alias(f"o{i}") for i in range(len(names))]
    row = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, n in enumerate(names)))
    return rows.agg(*sums, *only).select(F.inline(row))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["2024-1"])
    base = ~BASE.keeps(F.col("failed"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("rule_bits"))


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
n as (select doc_id, text, ws, len(ws) as n_words, list_sum(list_transform(ws, lambda x: length(x))) as wc,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '[a-z]')) as n_lower from w),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
p as (select doc_id, n_words, unnest(range(1, n_words - 1)) as i, ws from n where n_words >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from p),
r as (select doc_id, count(distinct j) as n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) as j from g where c > 1) group by doc_id),
m as (select n.doc_id, n_words::bigint as n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
        coalesce(n_lines, 0) as n_lines, n_upper, n_lower from n left join l using (doc_id) left join r using (doc_id)),
f as (select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > 3 * n_words)::int
        + 8 * (2 * n_dup_lines > n_lines and n_dup_lines > 2)::int + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::int
        + 32 * (2 * n_upper > n_upper + n_lower and n_upper > 20)::int)::bigint as rule_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 as base_failed, rule_bits = 0 as kept, rule_bits from f
"""
