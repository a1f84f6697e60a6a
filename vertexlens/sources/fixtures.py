"""Graphs derived from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.graph import Graph
from vertexlens.operators.ranking import dense_numbers

#: Offset of the right side's ids in bipartite graphs.
RIGHT = 1_000_000_000

SQL = {
    "events": "select user_id as src, nxt as dst from (select user_id, lead(user_id) over (order by ts, event_id) as nxt from events) where nxt is not null",
    "events_simple": "select distinct src, dst from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events) where src <> dst",
    "copurchase": "select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey",
    "supppart": f"select l_suppkey as src, {RIGHT} + l_partkey as dst from lineitem",
    "custpart": f"select distinct o_custkey as src, {RIGHT} + l_partkey as dst from orders join lineitem on o_orderkey = l_orderkey",
    "nation": "select distinct cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey",
}


#: Rows of a table for each task that pairs them.
PAIRED_ROWS = 200_000


def _tasks_for(rows: DataFrame) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PAIRED_ROWS))


def consecutive(events: DataFrame) -> DataFrame:
    """(src, dst): each event's user and the next event's if that has one, over all events in order of (ts, event_id), nulls last.

    The order is one sort by ranges, and the next event is the one with the next number: no task sorts everything, and no
    hour, second or user with many events is one task's work. Partitions are as many as the rows call for.
    """
    parts = _tasks_for(events)
    rows = dense_numbers(events.select("ts", "event_id", "user_id"), F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"), parts=parts)
    after = rows.where("user_id is not null").select((F.col("number") - 1).alias("number"), F.col("user_id").alias("dst"))
    return rows.repartition(parts, "number").join(after.repartition(parts, "number"), "number").select(F.col("user_id").alias("src"), "dst")


def bought_together(lines: DataFrame) -> DataFrame:
    """(src, dst) distinct, src < dst: parts of one order.

    Partitions are as many as the rows call for: a join's output is larger than its input, by which Spark would coalesce
    them, so a task's pairs would grow with the table.
    """
    parts = _tasks_for(lines)
    dealt = lines.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
    a = dealt.select("l_orderkey", F.col("l_partkey").alias("src"))
    b = dealt.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").repartition(parts, "src", "dst").distinct()


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    if name == "events":
        return consecutive(t("events"))
    if name == "events_simple":
        return consecutive(t("events")).where("src <> dst").distinct()
    if name == "copurchase":
        return bought_together(t("lineitem"))
    if name == "supppart":
        return t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + RIGHT).alias("dst"))
    if name == "custpart":
        o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
        return t("lineitem").select("l_orderkey", (F.col("l_partkey") + RIGHT).alias("dst")).join(o, "l_orderkey").select("src", "dst").distinct()
    if name == "nation":
        s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("src"))
        c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("dst"))
        o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
        return t("lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").join(o, "l_orderkey").select("src", "dst").distinct()
    raise ValueError(f"unknown graph {name!r}: one of {', '.join(SQL)}")


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The graph with its derived edges and vertices cached, as every operator reads them more than once."""
    g = Graph.from_edges(edges(spark, sf_dir, name).persist())
    return Graph(g.vertices.persist(), g.edges, g.spanned)
