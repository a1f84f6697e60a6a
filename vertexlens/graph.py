"""The data model: a directed multigraph as two DataFrames, and its message-passing primitives."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlens.functions.blocked_bloom import BlockedBloom
from vertexlens.lineage import cut_and_observe, cut_lineage

Direction = Literal["in", "out", "either"]


def _checked(direction: str) -> str:
    if direction not in ("in", "out", "either"):
        raise ValueError(f"direction {direction!r}: use 'in', 'out' or 'either' ('both' has no neighbour meaning)")
    return direction


@dataclass(frozen=True)
class Graph:
    """vertices(id bigint, attr int), edges(src bigint, dst bigint, attr int). Parallel edges and self-loops are kept.

    `spanned` tells that the vertices are the endpoints, so what packs all edges anyway need not derive them.
    """

    vertices: DataFrame
    edges: DataFrame
    spanned: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, default: int = 1) -> Graph:
        """Vertices are the endpoints, each with attribute `default`; edges without attr get 1."""
        if "attr" not in edges.columns:
            edges = edges.withColumn("attr", F.lit(1))
        edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("attr").cast("int").alias("attr"))
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(ids.withColumn("attr", F.lit(default)), edges, True)

    @property
    def triplets(self) -> DataFrame:
        """src, dst, attr, src_attr, dst_attr of every edge."""
        a = self.vertices.select(F.col("id").alias("src"), F.col("attr").alias("src_attr"))
        b = self.vertices.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "attr", "src_attr", "dst_attr")

    def renumbered(self) -> tuple[Graph, DataFrame]:
        """(the graph with vertices 0 .. |V| - 1 in order of id, (id, number) of every vertex); edges are between its vertices."""
        from vertexlens.operators.ranking import dense_numbers

        to = dense_numbers(self.vertices, "id")
        ends = [to.select(F.col("id").alias(end), F.col("number").alias(f"new_{end}")) for end in ("src", "dst")]
        edges = self.edges.join(ends[0], "src").join(ends[1], "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "attr")
        return Graph(to.select(F.col("number").alias("id"), *(c for c in self.vertices.columns if c != "id")), edges), to.select("id", "number")

    def map_vertices(self, attr: Column) -> Graph:
        return Graph(self.vertices.withColumn("attr", attr), self.edges)

    def induced(self, chosen: DataFrame) -> Graph:
        """chosen(id, attr) with the edges between its vertices, cached; multiplicity stays, edge attributes become 1."""
        return Graph(chosen, self.inside(chosen).select("src", "dst", F.lit(1).alias("attr")).persist())

    def inside(self, chosen: DataFrame, prefilter: float | None = None) -> DataFrame:
        """The edges between vertices of chosen(id).

        With a prefilter, a rate of false positives, a blocked Bloom filter of the chosen ids leaves out most other edges before
        the joins move them; one that is too large to send to every executor is not used.
        """
        keep, edges = chosen.select("id"), self.edges
        if prefilter is not None:
            bloom = BlockedBloom.sized(keep, prefilter)
            edges = bloom.keep(edges, "src", "dst") if bloom.is_small else edges
        return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def ends(edges: DataFrame, direction: Direction) -> DataFrame:
    """(id, other): each edge seen from its source ('out'), its target ('in') or from both sides ('either')."""
    _checked(direction)
    if direction == "out":
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    if direction == "in":
        return edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    sides = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.select(F.inline(sides))


def degrees(edges: DataFrame, direction: Direction = "either") -> DataFrame:
    """(id, degree bigint) with multiplicity; only vertices that have an edge on that side."""
    return ends(edges, direction).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degrees_with_zero(g: Graph, direction: Direction) -> DataFrame:
    return g.vertices.select("id").join(degrees(g.edges, direction), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def neighbor_sets(edges: DataFrame, direction: Direction) -> DataFrame:
    """(id, other) distinct: neighbour sets in long form, which any later join or count can take without collecting a hub."""
    return ends(edges, direction).distinct()


def neighbor_ids(g: Graph, direction: Direction, distinct: bool = False) -> DataFrame:
    """(id, neighbors array<bigint>) of every vertex, ascending, with repeats unless distinct; empty where there are none.

    A hub's array is as long as its degree; operators of this package work on ends() instead.
    """
    rows = ends(g.edges, direction)
    lists = rows.groupBy("id").agg(F.sort_array((F.collect_set if distinct else F.collect_list)("other")).alias("neighbors"))
    return g.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def neighbor_attrs(g: Graph, direction: Direction) -> DataFrame:
    """(id, neighbors array<struct<id, attr>>) of every vertex, ascending; empty where there are none."""
    attr = g.vertices.select(F.col("id").alias("other"), "attr")
    lists = ends(g.edges, direction).join(attr, "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), "attr"))).alias("neighbors"))
    return g.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<struct<id:bigint,attr:int>>")).alias("neighbors"))


def named(expressions: list[Column], column: str) -> bool:
    """Whether one of the expressions names the column, by its text; a text that Spark has cut short may."""
    return any(re.search(rf"\b{column}\b|more fields", str(e)) for e in expressions)


def triplets_with(g: Graph, expressions: list[Column]) -> DataFrame:
    """g.triplets, joined to the vertices at those ends only whose attribute the expressions name; edges are between vertices of g."""
    rows = g.edges.select("src", "dst", "attr")
    for end in ("src", "dst"):
        if named(expressions, f"{end}_attr"):
            rows = rows.join(g.vertices.select(F.col("id").alias(end), F.col("attr").alias(f"{end}_attr")), end)
    return rows


def aggregate_messages(g: Graph, merge: Callable[[Column], Column], to_src: Column | None = None, to_dst: Column | None = None) -> DataFrame:
    """(id, message): per vertex the merged messages of its edges. to_src and to_dst are expressions over triplets; null sends nothing.

    An end's attribute is joined only if an expression names it, so messages over edges alone move no vertex.
    """
    sent = [F.struct(F.col(end).alias("id"), m.alias("m")) for end, m in (("src", to_src), ("dst", to_dst)) if m is not None]
    rows = triplets_with(g, sent).select(F.inline(F.array(*sent))).where("m is not null")
    return rows.groupBy("id").agg(merge(F.col("m")).alias("message"))


def pregel(state: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], send: Column, merge: Callable[[Column], Column], program: Column, rounds: int, cut_every: int = 1) -> DataFrame:
    """Synchronous rounds over state(id, label, ...) and edges(src, dst, ...), or a function that joins a state to its edges.

    Each round every edge whose `send` (over the source's state and the edge) is not null sends it to dst; a vertex
    with messages gets label = `program`, over its state and `message`; a vertex without keeps its label.
    State columns are numbers; they are carried through the message aggregation itself, so a round shuffles once for
    the join and once for the aggregation, both hashed. A round reads the state twice, so by default every round is cut.
    """
    kept = [c for c in state.columns if c != "id"]
    kinds = dict(state.dtypes)
    for i in range(rounds):
        own = state.select("id", *kept, F.lit(None).cast("bigint").alias("m"))
        met = edges(state) if callable(edges) else state.join(edges, state["id"] == edges["src"])
        mail = met.select(F.col("dst").alias("id"), *(F.lit(None).cast(kinds[c]).alias(c) for c in kept), send.cast("bigint").alias("m"))
        met = own.unionByName(mail.where("m is not null")).groupBy("id").agg(*(F.max(c).alias(c) for c in kept), merge(F.col("m")).alias("message"))
        state = met.select("id", *(F.when(F.col("message").isNull(), F.col("label")).otherwise(program).alias("label") if c == "label" else F.col(c) for c in kept))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            state = cut_lineage(state)
    return state


def run_active(
    state: DataFrame, meet: Callable[[DataFrame], DataFrame], active: Column, send: Column, merge: Callable[[Column], Column], received: dict[str, Column], sent: dict[str, Column], most: int | None = None
) -> tuple[DataFrame, list[int]]:
    """(state, senders of each round): rounds over state(id, ...) in which only active vertices send.

    In a round the vertices for which `active` holds send `send` (over their row and the edge; null sends nothing) along the
    edges that `meet` joins them to; then their columns change by `sent`, and those of every vertex with messages by `received`,
    over its row and `message`, the merged messages. Without active vertices the rounds end, after `most` (if given) at the latest. How
    many are active is counted by the job that writes the round's vertices.
    """
    columns = [c for c in state.columns if c != "id"]
    on = F.coalesce(active, F.lit(False))
    state, seen = cut_and_observe(state, active=F.count_if(on))
    counts = []
    while seen["active"] and (most is None or len(counts) < most):
        counts.append(seen["active"])
        mail = meet(state.where(on)).select(F.col("dst").alias("id"), send.alias("m")).where("m is not null").groupBy("id").agg(merge(F.col("m")).alias("message"))
        after = state.select("id", *(F.when(on, sent[c]).otherwise(F.col(c)).alias(c) if c in sent else F.col(c) for c in columns))
        got = F.col("message").isNotNull()
        state = after.join(mail, "id", "left").select("id", *(F.when(got, received[c]).otherwise(F.col(c)).alias(c) if c in received else F.col(c) for c in columns))
        state, seen = cut_and_observe(state, active=F.count_if(on))
    return state, counts
