"""PageRank, exact personalised PageRank, and the label-propagation cores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vertexlens.graph import Graph, degrees, ends, pregel, run_active
from vertexlens.lineage import cut_lineage
from vertexlens.operators import blocks


#: Edges of one source that one partition may hold; more are dealt over several.
HUB_LINKS = 1_000_000
#: Links of a partition: a graph of few links has fewer partitions than the session's shuffles, one of many has more.
LEAST_LINKS, MOST_LINKS = 400_000, 1_000_000


@dataclass(frozen=True)
class Links:
    """rows(src, dst, c, w, salt) cached, dealt and sorted by source and salt; hubs(hub, salts) of the sources dealt over several salts.

    They lie in `parts` partitions; `few` tells that these are fewer than an aggregation has, which what meets them is dealt into by name.
    """

    rows: DataFrame
    hubs: DataFrame | None
    parts: int
    few: bool

    def meet(self, state: DataFrame, key: str = "id", dealt: bool = False) -> DataFrame:
        """state joined to the links of its `key`: a hub's row goes to each of its salts, everything else to one place; `dealt` by `deal` already or not."""
        if self.hubs is None:
            state = state if dealt else self.deal(state, key)
            return state.join(self.rows, state[key] == self.rows["src"])
        spread = state.join(F.broadcast(self.hubs), state[key] == self.hubs["hub"], "left")  # at most a row per HUB_LINKS edges
        spread = spread.withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        return spread.join(self.rows, (spread[key] == self.rows["src"]) & (spread["at"] == self.rows["salt"]))

    def deal(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """rows, dealt by key as the links are by source if they are in few partitions; an aggregation by key or `meet` then moves them no more."""
        return rows.repartition(self.parts, key) if self.few else rows

    def unpersist(self) -> None:
        self.rows.unpersist()


def by_source(edges: DataFrame, most: int | None = None, stay: DataFrame | None = None, weighted: bool = True) -> Links:
    """The links of edges(src, dst): parallel edges merged to c, w the share of src's out-edges that they are (if weighted).

    They are in as many partitions as an aggregation by vertex has, so joining to one moves no link, and in order of source,
    so no round sorts them; a small graph's are in fewer, one for each LEAST_LINKS edges, and a large one's in more. A source with
    more than `most` (HUB_LINKS) edges is salted by target, so no partition holds all of them. Edges move once; what tells hubs
    is pre-aggregated. Each vertex of stay(id), if given, has a link to itself, of c = 0 if it has no loop.
    """
    spark = edges.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or HUB_LINKS
    seen = Observation()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("links")).where(F.col("n") > most)
    hubs = cut_lineage(out.select(F.col("src").alias("hub"), F.ceil(F.col("n") / most).cast("int").alias("salts"), "n"))
    n_links = seen.get.get("links") or 0
    no_hubs = hubs.isEmpty()
    least = max(spark.sparkContext.defaultParallelism, -(-n_links // LEAST_LINKS))
    few = no_hubs and least < usual
    parts = least if few else max(usual, -(-n_links // MOST_LINKS))
    rows = edges.select("src", "dst", F.lit(1).alias("one"))
    if stay is not None:
        rows = rows.unionByName(stay.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("one")))
    if no_hubs:
        pairs = rows.repartition(parts, "src").groupBy("src", "dst").agg(F.sum("one").alias("c"))
        total = F.sum("c").over(Window.partitionBy("src"))
        pairs = pairs.withColumn("w", F.try_divide("c", total)) if weighted else pairs.sortWithinPartitions("src")
        return Links(pairs.persist(), None, parts, few)
    salted = rows.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left")
    salted = salted.select("src", "dst", "one", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "n")
    pairs = salted.repartition(parts, "src", "salt").groupBy("src", "salt", "dst").agg(F.sum("one").alias("c"), F.first("n").alias("n"))
    total = F.coalesce("n", F.sum("c").over(Window.partitionBy("src", "salt")))
    pairs = pairs.withColumn("w", F.try_divide("c", total)) if weighted else pairs.sortWithinPartitions("src", "salt")
    return Links(pairs.drop("n").persist(), hubs.drop("n"), parts, few)


def _surfer(ranks: DataFrame, base: DataFrame, links: Links, keep: float) -> DataFrame:
    """base(id, rank) plus keep * what flows over links: one join and one aggregation."""
    flow = links.meet(ranks, dealt=True).select(F.col("dst").alias("id"), (F.col("rank") * F.col("w") * keep).alias("rank"))
    return links.deal(base.unionByName(flow)).groupBy("id").agg(F.sum("rank").alias("rank"))


def pagerank(g: Graph, iterations: int = 10, reset: float = 0.15, init: float = 0.15, cut_every: int = 2) -> DataFrame:
    """(id, score) after a fixed number of rounds; not normalised, mass of vertices without out-edges is lost.

    The links are dealt once and cached, and released at the end. Where vertices have many edges they lie in blocks, and each round
    shuffles arrays of numbers; else they are dealt by source, and each round shuffles the flow.
    """
    if (c := blocks.pays(g)) is not None:
        return blocks.ranks(g, c, iterations, reset, init, cut_every)
    links = by_source(g.edges)
    base = g.vertices.select("id", F.lit(float(reset)).alias("rank"))
    ranks = links.deal(g.vertices.select("id", F.lit(float(init)).alias("rank")))
    for i in range(iterations):
        ranks = _surfer(ranks, base, links, 1 - reset)
        if (i + 1) % cut_every == 0 or i + 1 == iterations:
            ranks = links.deal(cut_lineage(ranks)) if i + 1 < iterations else cut_lineage(ranks)
    links.unpersist()
    return ranks.select("id", F.col("rank").alias("score"))


def pagerank_until(g: Graph, tolerance: float = 0.001, reset: float = 0.15, init: float = 1.0, most: int = 200) -> DataFrame:
    """(id, score) once no score moves by more than tolerance; links lie as in `pagerank`."""
    if (c := blocks.pays(g)) is not None:
        return blocks.ranks_until(g, c, tolerance, reset, init, most)
    links = by_source(g.edges)
    base = g.vertices.select("id", F.lit(float(reset)).alias("rank"))
    ranks = cut_lineage(g.vertices.select("id", F.lit(float(init)).alias("rank")))
    for _ in range(most):
        new = cut_lineage(_surfer(links.deal(ranks), base, links, 1 - reset))
        moved = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new
        if moved is None or moved <= tolerance:
            break
    links.unpersist()
    return ranks.select("id", F.col("rank").alias("score"))


def ppr_exact(g: Graph, alpha: float = 0.15, iterations: int = 30, cut_every: int = 2, sources: DataFrame | None = None) -> DataFrame:
    """(source, target, score) of every source (of sources(id), if given): the walk stops with probability alpha a step. Pairs reached only.

    Ids that are no vertices have no rows. By definition there are up to |V| rows a source, so a large graph needs
    `sources`; ppr_monte_carlo is bounded by its walks.
    """
    links = by_source(g.edges)
    first = g.vertices.select("id") if sources is None else g.vertices.select("id").join(sources.select("id"), "id", "left_semi")
    base = first.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(float(alpha)).alias("score"))
    now = base
    for i in range(iterations):
        flow = links.meet(now, "target").select("source", F.col("dst").alias("target"), (F.col("score") * F.col("w") * (1 - alpha)).alias("score"))
        now = base.unionByName(flow).groupBy("source", "target").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0 or i + 1 == iterations:
            now = cut_lineage(now)
    links.unpersist()
    return now


def _label_rounds(g: Graph, k: int, at_least: bool, rounds: int) -> DataFrame:
    out = g.vertices.select("id").join(degrees(g.edges, "out"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("out_degree"))
    holds = (lambda x: x >= k) if at_least else (lambda x: x <= k)
    state = out.select("id", holds(F.col("out_degree")).cast("int").alias("label"), "out_degree")
    links = by_source(g.edges)
    send = F.when(F.col("label") == 1, F.col("c"))
    found = cut_lineage(pregel(state, links.meet, send, F.sum, holds(F.col("out_degree") + F.col("message")).cast("int"), rounds).select("id", "label"))
    links.unpersist()
    return found


def kcore_heuristic(g: Graph, k: int, rounds: int = 15) -> DataFrame:
    """(id, label): 1 where out-degree plus edges from label-1 sources is at least k, after synchronous rounds.

    Vertices without a message keep their label. This is not the textbook core: see kcore.
    """
    return _label_rounds(g, k, True, rounds)


def kdegenerate_heuristic(g: Graph, k: int, rounds: int = 15) -> DataFrame:
    """As kcore_heuristic with at most k; it may oscillate, so the number of rounds is part of the result."""
    return _label_rounds(g, k, False, rounds)


def kcore(g: Graph, k: int) -> DataFrame:
    """(id): the textbook k-core of the undirected simple graph, by peeling until nothing goes.

    Edges are dealt once and never written again: a round tells the neighbours of the vertices that go how many went, and
    writes a number a vertex.
    """
    if k <= 0:
        return g.vertices.select("id")
    both = ends(g.edges.where("src <> dst"), "either").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    links = by_source(both, weighted=False)
    state = links.rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("left"))  # null: gone
    left = {"left": F.col("left") - F.col("message")}
    state, _ = run_active(state, links.meet, F.col("left") < k, F.lit(1), F.sum, left, {"left": F.lit(None).cast("bigint")})
    links.unpersist()
    return state.where("left is not null").select("id")


def kdegenerate(g: Graph, k: int) -> DataFrame:
    """(id): vertices outside the (k + 1)-core."""
    return g.vertices.select("id").join(kcore(g, k + 1), "id", "left_anti")


def pagerank_active(g: Graph, tolerance: float = 0.001, reset: float = 0.15, most: int = 1000, cut_every: int = 2) -> tuple[DataFrame, list[int]]:
    """((id, score), senders of each round): PageRank by rank deltas of the vertices that still move.

    A vertex sends what its score has gained since it last sent, once that is over tolerance; no other one sends in a
    round, and the rounds end by themselves, as at most 1 - reset of what is sent arrives. What is never sent is at most
    tolerance a vertex, so no score is too high, and in sum they are too low by (1 - reset) / reset * tolerance * |V| at most.

    Every vertex has a link to itself, along which it keeps its own, so a round reads the state once, and `cut_every` rounds
    are one plan: a join and an aggregation each. How many send is observed as they pass; rounds beyond the last change nothing.
    A vertex without id keeps `reset`: edges to it count for their source, but nothing flows to or from it.
    """
    known = g.vertices.where("id is not null")
    links = by_source(g.edges, stay=known)
    on, own = F.col("gain") > tolerance, F.col("src") == F.col("dst")
    flow = F.when(on, F.coalesce(F.col("gain") * F.col("w") * (1 - reset), F.lit(0.0))).otherwise(0.0)
    kept = [F.when(own, F.col("rank")).otherwise(0.0).alias("rank"), F.when(own & ~on, F.col("gain")).otherwise(0.0).alias("gain")]
    state = known.select("id", F.lit(float(reset)).alias("rank"), F.lit(float(reset)).alias("gain"))
    sent: list[int] = []
    while len(sent) < most:
        state, seen = links.deal(state), []
        for _ in range(min(cut_every, most - len(sent))):
            seen.append(Observation())
            met = links.meet(state.observe(seen[-1], F.count_if(on).alias("active")), dealt=True).where(own | (on & F.col("dst").isNotNull()))
            mail = links.deal(met.select(F.col("dst").alias("id"), *kept, flow.alias("m"))).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("rank", "gain", "m")))
            state = mail.select("id", (F.col("rank") + F.col("m")).alias("rank"), (F.col("gain") + F.col("m")).alias("gain"))
        state = cut_lineage(state)
        counts = [o.get.get("active") or 0 for o in seen]
        sent += [n for n in counts if n]
        if not counts[-1]:
            break
    links.unpersist()
    nameless = g.vertices.where("id is null").select("id", F.lit(float(reset)).alias("score"))
    return state.select("id", F.col("rank").alias("score")).unionByName(nameless), sent


def distances(g: Graph, sources: DataFrame, most: int = 10_000) -> tuple[DataFrame, list[int]]:
    """((id, distance), senders of each round): edges of the shortest path from any of sources(id), null where there is none.

    Only vertices reached in the last round send.
    """
    links = by_source(g.edges)
    start = g.vertices.select("id").join(sources.select("id", F.lit(0).cast("bigint").alias("distance")).distinct(), "id", "left")
    state = start.select("id", "distance", F.when(F.col("distance") == 0, F.lit(1)).otherwise(F.lit(0)).alias("new"))
    reached = F.col("distance").isNull()
    after = {"distance": F.coalesce("distance", "message"), "new": F.when(reached, F.lit(1)).otherwise(F.lit(0))}
    state, sent = run_active(state, links.meet, F.col("new") == 1, (F.col("distance") + 1).alias("distance"), F.min, after, {"new": F.lit(0)}, most)
    links.unpersist()
    return state.select("id", "distance"), sent
