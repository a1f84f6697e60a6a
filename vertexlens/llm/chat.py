"""Preference formatting of paired conversations.

The longest common turn prefix of the chosen and the rejected conversation is rendered once, as the prompt; what
follows it in each becomes a completion with a mask that trains on assistant turns only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlens.llm.frames import table


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is before + role + between + text + after; mask_role's turns are trained on."""

    before: str = "<|"
    between: str = "|>\n"
    after: str = "\n"
    mask_role: str = "assistant"

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.before), role, F.lit(self.between))


def preference_pairs(turns: DataFrame, t: ChatTemplate = ChatTemplate(), dealt: bool = False) -> DataFrame:
    """One row per pair_id, from rows (pair_id, side, turn, role, text) with side `chosen` or `rejected`.

    dealt: turns are partitioned by pair_id already.

    n_common: turns of the longest common prefix (equal role and text at equal place); prompt: its rendering; and for
    each side: the completion, and its mask as runs `masked:trained` of code points joined by commas (the head of a
    turn is masked, a trained turn's text and end mark are not).

    Turns are in order of turn, then role and text, so ties have a defined order; null role or text counts as empty.
    A pair that lacks a side, or whose sides are equal, has that completion (or both) empty with an empty mask. Rows with
    a null pair_id or another side are left out: they belong to no pair. Other columns are ignored.
    """
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = rows.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows if dealt else rows.repartition("pair_id")  # serves every window and the aggregation below
    at = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(at))
    place = Window.partitionBy("pair_id", "place")
    met = F.count(F.lit(1)).over(place)
    same = (met == 2) & (F.min(F.struct("role", "text")).over(place) == F.max(F.struct("role", "text")).over(place))
    first_other = F.min(F.when(~F.col("same"), F.col("place"))).over(Window.partitionBy("pair_id"))
    rows = rows.withColumn("same", same)
    rows = rows.withColumn("common", F.coalesce(first_other - 1, F.max("place").over(Window.partitionBy("pair_id"))))
    turn = F.concat(t.head(F.col("role")), F.col("text"), F.lit(t.after))
    # length of the turn's masked and trained part
    trained = F.when(F.col("role") == t.mask_role, F.length(F.concat("text", F.lit(t.after)))).otherwise(0)
    part = F.struct("place", turn.alias("s"), (F.length(turn) - trained).alias("m"), trained.alias("n"))
    in_prompt = F.col("place") <= F.col("common")

    def listed(where: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(where, part)))

    side = lambda s: listed(~in_prompt & (F.col("side") == s))
    # the prompt is the same on both sides: take the chosen one
    grouped = rows.groupBy("pair_id").agg(
        F.max("common").cast("bigint").alias("n_common"),
        listed(in_prompt & (F.col("side") == "chosen")).alias("_p"), side("chosen").alias("_c"), side("rejected").alias("_r"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["m"].cast("string"), x["n"].cast("string"))), ",")
    return grouped.select("pair_id", "n_common", text("_p").alias("prompt"), text("_c").alias("chosen"), mask("_c").alias("chosen_mask"), text("_r").alias("rejected"), mask("_r").alias("rejected_mask"))


def echoed(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text): each conversation of turns(pair_id, turn, role, text) as chosen, and once more as rejected.

    In the rejected one the last assistant turn echoes the turn before it (empty if there is none). Without an assistant
    turn both are equal. Turns are in order of turn, role and text.
    """
    at = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(at)).withColumn("before", F.coalesce(F.lag("text").over(at), F.lit("")))
    last = F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(Window.partitionBy("pair_id"))
    both = placed.withColumn("last", last).withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    text = F.when((F.col("side") == "rejected") & (F.col("place") == F.col("last")), F.col("before")).otherwise(F.col("text"))
    return both.select("pair_id", "side", "turn", "role", text.alias("text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each conversation: chosen as it is, rejected with a worse last assistant turn."""
    c = table(spark, sf_dir, "conversations")
    pairs = echoed(c.select(F.col("conv_id").cast("bigint").alias("pair_id"), "turn", "role", "text").repartition("pair_id"))
    return preference_pairs(pairs, dealt=True)


OP5_SQL = r"""
with o as (select conv_id, turn, role, text, row_number() over q as place, lag(text) over q as before from conversations where conv_id is not null window q as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
e as (select *, max(place) filter (role = 'assistant') over (partition by conv_id) as last from o),
t as (select conv_id as pair_id, side, turn, coalesce(role, '') as role, coalesce(case when side = 'rejected' and place = last then before else text end, '') as text from e, (values ('chosen'), ('rejected')) as s(side)),
p as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as place from t),
s as (select pair_id, place, count(*) = 2 and min(role || chr(0) || text) = max(role || chr(0) || text) as same from p group by pair_id, place),
n as (select pair_id, coalesce(min(case when not same then place end) - 1, max(place)) as common from s group by pair_id),
r as (select p.*, common, '<|' || role || '|>' || chr(10) as head, text || chr(10) as tail from p join n using (pair_id)),
m as (select *, head || tail as full_turn, (case when role = 'assistant' then length(head) || ':' || length(tail) else (length(head) + length(tail)) || ':0' end) as mask from r)
select pair_id, max(common)::bigint as n_common,
  coalesce(string_agg(full_turn, '' order by place) filter (side = 'chosen' and place <= common), '') as prompt,
  coalesce(string_agg(full_turn, '' order by place) filter (side = 'chosen' and place > common), '') as chosen,
  coalesce(string_agg(mask, ',' order by place) filter (side = 'chosen' and place > common), '') as chosen_mask,
  coalesce(string_agg(full_turn, '' order by place) filter (side = 'rejected' and place > common), '') as rejected,
  coalesce(string_agg(mask, ',' order by place) filter (side = 'rejected' and place > common), '') as rejected_mask
from m group by pair_id
"""
