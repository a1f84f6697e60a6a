"""The registered queries over the derived graphs, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlens.functions import scalars
from vertexlens.functions.blocked_bloom import BlockedBloom
from vertexlens.functions.bloom import BloomFilter
from vertexlens.functions.rng import geometric, geometric_continue, geometric_value, uniform, uniform_sql, uniform_value
from vertexlens.graph import Graph, aggregate_messages, degrees, ends, neighbor_attrs, neighbor_ids
from vertexlens.lineage import cut_lineage, shared_folder
from vertexlens.operators import clustering as cl
from vertexlens.operators import fires as fi
from vertexlens.operators import metrics as me
from vertexlens.operators import ranks as rk
from vertexlens.operators import sampling as sa
from vertexlens.operators import walkers as wk
from vertexlens.operators import walks as wl
from vertexlens.operators.components import component_count, connected_components
from vertexlens.operators.split import split_by_degree
from vertexlens.plans.experiment import run_experiment
from vertexlens.sources import fixtures
from vertexlens.sources.adjacency import stored
from vertexlens.sources.edges import append_csv, canonical_edges, read_delimited_edges, read_edge_list, read_graph, write_graph
from vertexlens.streaming.reservoirs import latest, reservoirs

SEED = 42
FRACTION = 0.15
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _with(fixture: str, *ctes: str, final: str) -> str:
    return f"with e as ({fixtures.SQL[fixture]}), " + ", ".join(("v as (select distinct unnest([src, dst]) as id from e)", *ctes)) + " " + final


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


_DEG = {
    "either": "select unnest([src, dst]) as id from e",
    "in": "select dst as id from e",
    "out": "select src as id from e",
}
_ENDS = {
    "either": "select src as id, dst as other from e union all select dst, src from e",
    "in": "select dst as id, src as other from e",
    "out": "select src as id, dst as other from e",
}


# --- degrees, neighbours, orientation -------------------------------------------------------------------------------
for _name, _d in (("total", "either"), ("in", "in"), ("out", "out")):
    query(f"degrees_{_name}", _with("events", final=f"select id, count(*) as degree from ({_DEG[_d]}) group by id"))(lambda s, d, k=_d: degrees(fixtures.edges(s, d, "events"), k))

for _d in ("out", "in", "either"):
    query(f"neighbor_ids_{_d}", _with("events", f"n as ({_ENDS[_d]})", final="select v.id, coalesce(string_agg(other::varchar, ',' order by other), '') as neighbors from v left join n on v.id = n.id group by v.id"))(
        lambda s, d, k=_d: neighbor_ids(fixtures.graph(s, d, "events"), k).select("id", _joined("neighbors"))
    )
    query(f"neighbor_sets_{_d}", _with("events", f"n as (select distinct * from ({_ENDS[_d]}))", final="select v.id, coalesce(string_agg(other::varchar, ',' order by other), '') as neighbors from v left join n on v.id = n.id group by v.id"))(
        lambda s, d, k=_d: neighbor_ids(fixtures.graph(s, d, "events"), k, distinct=True).select("id", _joined("neighbors"))
    )


@query("indegree_signatures", _with("events", "n as (select dst as id, count(*) as c from e group by dst)", final="select v.id, coalesce(c, 0) as in_degree from v left join n on v.id = n.id"))
def _(spark, d):
    return wk.signatures(fixtures.graph(spark, d, "events"))


@query("neighbor_attr_pairs", _with("supppart", "g as (select id, count(*) as attr from (select unnest([src, dst]) as id from e) group by id)", "n as (select src as id, g.id as other, attr from e join g on g.id = dst)",
    final="select v.id, coalesce(string_agg(other || ':' || attr, ',' order by other, attr), '') as pairs, coalesce(max(attr), -1)::int as max_attr from v left join n on v.id = n.id group by v.id"))
def _(spark, d):
    e = fixtures.edges(spark, d, "supppart")
    g = Graph(degrees(e).select("id", F.col("degree").cast("int").alias("attr")), e)
    pairs = F.array_join(F.transform("neighbors", lambda p: F.concat_ws(":", p["id"].cast("string"), p["attr"].cast("string"))), ",")
    return neighbor_attrs(g, "out").select("id", pairs.alias("pairs"), scalars.max_pair(F.col("neighbors")).alias("max_attr"))


@query("canonical_edges", _with("events", final="select least(src, dst) as src, greatest(src, dst) as dst, 1 as attr from e"))
def _(spark, d):
    return canonical_edges(fixtures.edges(spark, d, "events"))


@query("from_edges_vertices", _with("custpart", final="select id, 1 as attr from v"))
def _(spark, d):
    return fixtures.graph(spark, d, "custpart").vertices


@query("triplet_messages", _with("events", "g as (select id, count(*) as a from (select src as id from e) group by id)", "w as (select v.id, coalesce(a, 0) as a from v left join g on v.id = g.id)",
    final="select e.dst as id, sum(w.a)::bigint as message from e join w on w.id = e.src group by e.dst"))
def _(spark, d):
    e = fixtures.edges(spark, d, "events")
    g = fixtures.graph(spark, d, "events")
    out = g.vertices.select("id").join(degrees(e, "out"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("int").alias("attr"))
    return aggregate_messages(Graph(out, g.edges), F.sum, to_dst=F.col("src_attr").cast("bigint"))


# --- sources and sinks: written to the shared folder and read back ------------------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


@query("edge_list_scan", _with("events", final="select src, dst, 1 as attr from e"))
def _(spark, d):
    path = _folder(spark, "edge_list")
    fixtures.edges(spark, d, "events").select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    return read_edge_list(spark, path)


@query("graph_round_trip", _with("events", final="select src, dst, 1 as attr from e"))
def _(spark, d):
    path = _folder(spark, "graph")
    write_graph(fixtures.graph(spark, d, "events"), path)
    return read_graph(spark, path).edges


@query("csv_append", _with("events", final="select dst as id, count(*) as degree from e group by dst union all select src, count(*) from e group by src"))
def _(spark, d):
    path = _folder(spark, "csv")
    for k in ("in", "out"):
        append_csv(degrees(fixtures.edges(spark, d, "events"), k), path)
    return spark.read.schema("id bigint, degree bigint").csv(path)


@query("tab_separated_signatures", _with("events", final="select src as id, count(*) as in_degree from e group by src"))
def _(spark, d):
    path = _folder(spark, "tsv")
    fixtures.edges(spark, d, "events").write.csv(path, sep="\t")
    return read_delimited_edges(spark, path)[1]


@query("map_vertices", _with("events", final="select id, (id % 7)::int as attr from v"))
def _(spark, d):
    return fixtures.graph(spark, d, "events").map_vertices((F.col("id") % 7).cast("int")).vertices


@query("dense_numbers", _with("supppart", final="select id, row_number() over (order by id) - 1 as number from v"))
def _(spark, d):
    return fixtures.graph(spark, d, "supppart").renumbered()[1]


@query("renumbered_edges", _with("supppart", "n as (select id, row_number() over (order by id) - 1 as number from v)", final="select a.number as src, b.number as dst from e join n a on a.id = e.src join n b on b.id = e.dst"))
def _(spark, d):
    return fixtures.graph(spark, d, "supppart").renumbered()[0].edges.select("src", "dst")


@query("sorted_vertices", _with("events", final="select id, 1 as attr from v order by id"))
def _(spark, d):
    return fixtures.graph(spark, d, "events").vertices.orderBy("id")


@query("distinct_edges", _with("events", final="select distinct src, dst, 1 as attr from e"))
def _(spark, d):
    return fixtures.graph(spark, d, "events").edges.dropDuplicates(["src", "dst", "attr"])


@query("degree_lines", _with("events", f"n as ({_DEG['either']})", final="select concat_ws(',', id, count(*)) as line from n group by id"))
def _(spark, d):
    return degrees(fixtures.edges(spark, d, "events")).select(F.concat_ws(",", "id", "degree").alias("line"))


# --- samplers -------------------------------------------------------------------------------------------------------
_OCC = "o as (select src, dst, row_number() over (partition by src, dst) as occ from e)"
_U_EDGE = uniform_sql(SEED, "src", "dst", "occ")


def _edge_rows(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst")


@query("node_sample_vertices", _with("copurchase", final=f"select id from v where {uniform_sql(SEED, 'id')} < {FRACTION}"))
def _(spark, d):
    return sa.node_sample(fixtures.graph(spark, d, "copurchase"), FRACTION, SEED).vertices.select("id")


@query("node_sample", _with("copurchase", f"k as (select id from v where {uniform_sql(SEED, 'id')} < {FRACTION})", final="select src, dst from e where src in (select id from k) and dst in (select id from k)"))
def _(spark, d):
    return _edge_rows(sa.node_sample(fixtures.graph(spark, d, "copurchase"), FRACTION, SEED))


for _f in ("copurchase", "events"):
    query(f"edge_sample_{_f}", _with(_f, _OCC, final=f"select src, dst from o where {_U_EDGE} < {FRACTION}"))(lambda s, d, f=_f: _edge_rows(sa.edge_sample(fixtures.graph(s, d, f), FRACTION, SEED)))
    query(f"edge_by_vertex_sample_{_f}", _with(_f, _OCC, f"r as (select src, dst, row_number() over (partition by src order by {_U_EDGE}, dst, occ) as r, count(*) over (partition by src) as n from o)", final="select src, dst from r where r <= floor(n * 0.3 + 0.5)"))(
        lambda s, d, f=_f: _edge_rows(sa.edge_by_vertex_sample(fixtures.graph(s, d, f), 0.3, SEED))
    )


@query("no_sample", _with("events", final="select src, dst from e"))
def _(spark, d):
    return _edge_rows(sa.sampler(sa.SampleKind.NONE)(fixtures.graph(spark, d, "events"), FRACTION, SEED))


@query("reservoir_k", f"with r as (select user_id, event_id, row_number() over (partition by user_id order by {uniform_sql(SEED, 'user_id', 'event_id')}, event_id) as r, count(*) over (partition by user_id) as n from events) select user_id, event_id from r where r <= floor(n * 0.25 + 0.5)")
def _(spark, d):
    return sa.reservoir_sample(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_id", 0.25, SEED)


@query("stream_reservoirs", f"select user_id as id, event_id as item from events qualify row_number() over (partition by user_id order by {uniform_sql(SEED, 'user_id', 'event_id')}, event_id) <= 5")
def _(spark, d):
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(kind).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream's plain path must be a folder
    return latest(spark, reservoirs(stream.select(F.col("user_id").alias("id"), F.col("event_id").alias("item")), 5, SEED), f"stream-{uuid.uuid4().hex}")


@query("uniform_k_subset", _with("copurchase", f"r as (select id, row_number() over (order by {uniform_sql(SEED, 'id')}, id) as r, count(*) over () as n from v)", final="select id from r where r <= floor(n * 0.15)"))
def _(spark, d):
    return sa.uniform_subset(fixtures.graph(spark, d, "copurchase").vertices, FRACTION, SEED).select("id")


@query("multi_sample", _with("events", _OCC, f"s as (select unnest(range(0, 3))::int as sample_id)", final=f"select sample_id, src, dst from o, s where {uniform_sql(SEED, 'sample_id', 'src', 'dst', 'occ')} < {FRACTION}"))
def _(spark, d):
    return sa.edge_samples(fixtures.graph(spark, d, "events"), FRACTION, 3, SEED).select("sample_id", "src", "dst")


_REPEATS = [f"k{i} as (select id from v where {uniform_sql(SEED + i, 'id')} < {FRACTION})" for i in range(3)]


@query("repeated_node_samples", _with("copurchase", *_REPEATS, final=" union all ".join(f"select {i} as sample_id, src, dst from e where src in (select id from k{i}) and dst in (select id from k{i})" for i in range(3))))
def _(spark, d):
    samples = sa.repeat_stored(sa.node_sample, fixtures.graph(spark, d, "copurchase"), FRACTION, 3, SEED)
    return reduce(DataFrame.unionByName, (s.edges.select(F.lit(i).alias("sample_id"), "src", "dst") for i, s in enumerate(samples)))


_SPLIT = (
    "g as (select id, count(*) as degree from (select unnest([src, dst]) as id from e) group by id)",
    "h as (select degree, count(*)::double as n from g group by degree)",
    "p as (select degree, sum(n) over w as n1, sum(n * degree) over w as s1, sum(n) over () as n0, sum(n * degree) over () as s0 from h window w as (order by degree))",
    "c as (select s1 / n1 as lo, (s0 - s1) / (n0 - n1) as hi from p where n1 < n0 order by s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) desc, degree limit 1)",
    "sp as (select g.*, coalesce(abs(degree - lo) < abs(degree - hi), false) as sparse from g left join c on true)",
)
for _f in ("supppart", "events", "copurchase"):

    def _split(s, d, f=_f):
        sparse, dense = split_by_degree(degrees(fixtures.edges(s, d, f)))
        return sparse.withColumn("sparse", F.lit(True)).unionByName(dense.withColumn("sparse", F.lit(False)))

    query(f"degree_split_2means_{_f}", _with(_f, *_SPLIT, final="select id, degree, sparse from sp"))(_split)


@query("layered_sample", _with("supppart", *_SPLIT, f"k as (select id from sp where not sparse or {uniform_sql(SEED, 'id')} < {FRACTION})", final="select src, dst from e where src in (select id from k) and dst in (select id from k)"))
def _(spark, d):
    g = fixtures.graph(spark, d, "supppart")
    sparse, dense = split_by_degree(degrees(g.edges))
    return _edge_rows(sa.layered_sample(g, FRACTION, sparse, dense, SEED))


_WEIGHTED = (
    "dg as (select id, count(*) as degree from (select unnest([src, dst]) as id from e) group by id)",
    "ly as (select id, degree, length(bin(degree)) - 1 as layer from dg)",
    f"wk as (select *, row_number() over (partition by layer order by -ln(greatest({uniform_sql(SEED, 'id')}, 1e-300)) / degree, id) as r, count(*) over (partition by layer) as n from ly)",
)


@query("weighted_layered_vertices", _with("copurchase", *_WEIGHTED, final=f"select id, degree, layer::int as layer from wk where r <= floor(n * {FRACTION} + 0.5)"))
def _(spark, d):
    return sa.weighted_subset(sa.degree_layers(fixtures.graph(spark, d, "copurchase")), FRACTION, SEED).select("id", "degree", "layer")


@query("weighted_layered_sample", _with("copurchase", *_WEIGHTED, f"k as (select id from wk where r <= floor(n * {FRACTION} + 0.5))", final="select src, dst from e where src in (select id from k) and dst in (select id from k)"))
def _(spark, d):
    return _edge_rows(sa.weighted_layered_sample(fixtures.graph(spark, d, "copurchase"), FRACTION, SEED))


_DICE = (
    "o as (select distinct src as id, dst as other from e)",
    "q as (select other from o where id = 1 union select 1)",
    "w as (select v.id, count(o.other) as n, count(q.other) as c from v left join o on v.id = o.id left join q on q.other = o.other group by v.id)",
    "x as (select id, 2.0 * c / nullif((select count(*) from q) - 1 + n, 0) as weight from w)",
    f"k as (select id from x where {uniform_sql(SEED, 'id')} < weight)",
)


@query("cocitation_weights", _with("copurchase", *_DICE, final="select id, round(weight, 6) as weight from x"))
def _(spark, d):
    return sa.cocitation_weights(fixtures.graph(spark, d, "copurchase"), 1).select("id", F.round("weight", 6).alias("weight"))


@query("cocitation_sample", _with("copurchase", *_DICE, final="select id as src, other as dst from o where id in (select id from k)"))
def _(spark, d):
    return _edge_rows(sa.cocitation_sample(fixtures.graph(spark, d, "copurchase"), 1, SEED))


@query("cocitation_intersect", _with("copurchase", *_DICE, final="select id as src, other as dst from o where id in (select id from k) and other in (select other from q)"))
def _(spark, d):
    return _edge_rows(sa.cocitation_intersect_sample(fixtures.graph(spark, d, "copurchase"), 1, SEED))


_FIRE, _FIRE_SHARE, _FIRE_ROUNDS = fi.FireParams(forward=0.65, backward=0.3), 0.4, 60  # at sf0.01 the last of them burn nothing


def _fire_ctes() -> list[str]:
    """Rounds of fires, one CTE each: what the last round lit spreads, or new fires start."""
    u = lambda *keys: uniform_sql(SEED, *keys)
    fan = lambda way, p: f"floor(ln(greatest({u('f.id', repr(way + 'fan'))}, 1e-300)) / ln({p}::double))"
    steps = ["wanted as (select floor(count(*) * 0.4)::bigint as n from v)"]
    for way in ("out", "in"):
        steps.append(f"n{way} as materialized (select distinct id, other from ({_ENDS[way]}) where id <> other)")
    steps.append("b0 as (select id, 0 as round, id as fire from v where false)")
    for i in range(_FIRE_ROUNDS):
        lit = " union all ".join(
            f"(select other as id, fire from b{i} f join n{way} n using (id) where f.round = {i - 1} and other not in (select id from b{i}) qualify row_number() over (partition by f.id order by {u('f.id', 'other', repr(way))}, other) <= {fan(way, p)})"
            for way, p in (("out", _FIRE.forward), ("in", _FIRE.backward))
        )
        steps += [
            f"l{i} as materialized (select id, min(fire) as fire from ({lit}) group by id)",
            f"c{i} as (select id, id as fire from v where id not in (select id from b{i}) and not exists (select 1 from l{i}) qualify row_number() over (order by {u('id', repr('spark'))}, id) <= (select greatest(1, floor({_FIRE.sparks} * n)) from wanted))",
            f"y{i} as (select id, fire, row_number() over (order by {u('id', repr('last'))}, id) as r from l{i})",
            f"x{i} as (select id, fire, row_number() over (order by {u('id', repr('spark'))}, id) as r from c{i})",
            f"b{i + 1} as materialized (select * from b{i} union all select id, {i}, fire from (select * from y{i} union all select * from x{i}) where r <= (select n from wanted) - (select count(*) from b{i}))",
        ]
    return steps


@query("forest_fire_vertices", _with("events_simple", *_fire_ctes(), final=f"select id, round, fire from b{_FIRE_ROUNDS}"))
def _(spark, d):
    return fi.forest_fire(fixtures.graph(spark, d, "events_simple"), _FIRE_SHARE, SEED, _FIRE)


@query("forest_fire_sample", _with("events_simple", *_fire_ctes(), final=f"select src, dst from e where src in (select id from b{_FIRE_ROUNDS}) and dst in (select id from b{_FIRE_ROUNDS})"))
def _(spark, d):
    return _edge_rows(fi.forest_fire_sample(fixtures.graph(spark, d, "events_simple"), _FIRE_SHARE, SEED, _FIRE))


# --- ranks ----------------------------------------------------------------------------------------------------------
def _pagerank_ctes(edges: str = "e", vertices: str = "v", tag: str = "", rounds: int = 10, init: float = 0.15) -> list[str]:
    steps = [f"o{tag} as (select src, count(*) as n from {edges} group by src)", f"p{tag}0 as (select id, {init}::double as r from {vertices})"]
    for i in range(rounds):
        steps.append(f"p{tag}{i + 1} as (select v.id, 0.15 + 0.85 * coalesce(f, 0) as r from {vertices} v left join (select e.dst, sum(p.r / o.n) as f from {edges} e join p{tag}{i} p on p.id = e.src join o{tag} o on o.src = e.src group by e.dst) x on x.dst = v.id)")
    return steps


for _f in ("events", "copurchase"):
    query(f"pagerank_10_{_f}", _with(_f, *_pagerank_ctes(), final="select id, round(r, 6) as score from p10"))(lambda s, d, f=_f: rk.pagerank(fixtures.graph(s, d, f), 10).select("id", F.round("score", 6).alias("score")))

_PAIR = (_OCC, f"se as (select src, dst from o where {_U_EDGE} < {FRACTION})", "sv as (select distinct unnest([src, dst]) as id from se)", *(c.replace("o as (select src, count", "od as (select src, count").replace("join o o", "join od o") for c in _pagerank_ctes()), *_pagerank_ctes("se", "sv", "s"))
_TOP = ("t1 as (select id from p10 order by round(r, 9) desc, id limit 100)", "t2 as (select id from ps10 order by round(r, 9) desc, id limit 100)")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = fixtures.graph(spark, d, "copurchase")
    return rk.pagerank(g, 10), rk.pagerank(sa.edge_sample(g, FRACTION, SEED), 10)


@query("pagerank_topk_intersection", _with("copurchase", *_PAIR, *_TOP, final="select count(*) as intersection from t1 where id in (select id from t2)"))
def _(spark, d):
    return me.topk_intersection(*_both(spark, d))


@query("pagerank_mean_abs_error", _with("copurchase", *_PAIR, final="select round(sum(coalesce(abs(b.r - a.r), 0)) / count(*), 6) as error from ps10 b left join p10 a using (id)"))
def _(spark, d):
    return me.mean_abs_error(*_both(spark, d)).select(F.round("error", 6).alias("error"))


# The longest common subsequence of two lists of distinct ids is the longest increasing run of places.
_LCS = (
    "a as (select id, row_number() over (order by round(r, 9) desc, id) as i from p10 qualify i <= 100)",
    "b as (select id, row_number() over (order by round(r, 9) desc, id) as j from ps10 qualify j <= 100)",
    "pl as (select coalesce(list(j order by i), []) as p from a join b using (id))",
    "ls as (select 0 as i, []::bigint[] as l, p from pl union all select i + 1, list_append(l, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda x: case when p[x] < p[i + 1] then l[x] else 0 end)), 0)), p from ls where i < len(p))",
    "ed as (select ((select count(*) from a) + (select count(*) from b) - 2 * coalesce(list_max(l), 0))::int as edit_distance from ls order by i desc limit 1)",
)
_EDIT = _with("copurchase", *_PAIR, *_LCS, final="select edit_distance from ed").replace("with e as", "with recursive e as", 1)


@query("pagerank_edit_distance", _EDIT)
def _(spark, d):
    return me.topk_edit_distance(*_both(spark, d))


_MOST_ROUNDS = 60  # the score falls by 0.85 a round at least as long as it moves, so 0.001 is reached before
_UNTIL = (
    *(c.replace(" as (", " as materialized (", 1) for c in _pagerank_ctes(rounds=_MOST_ROUNDS, init=1.0)),
    "mv as (" + " union all ".join(f"select {i + 1} as k, max(abs(a.r - b.r)) as m from p{i + 1} a join p{i} b using (id)" for i in range(_MOST_ROUNDS)) + ")",
    "stop as (select min(k) as k from mv where m <= 0.001)",
)


@query("pagerank_tolerance", _with("events", *_UNTIL, final=" union all ".join(f"select id, round(r, 6) as score from p{k} where {k} = (select k from stop)" for k in range(1, _MOST_ROUNDS + 1))))
def _(spark, d):
    return rk.pagerank_until(fixtures.graph(spark, d, "events"), 0.001).select("id", F.round("score", 6).alias("score"))


_ACTIVE = [
    "o as (select src, count(*) as n from e group by src)",
    "a0 as materialized (select id, 0.15::double as r, 0.15::double as d from v)",
    *(
        f"a{i + 1} as materialized (select a.id, r + coalesce(f, 0) as r, case when d > 0.001 then 0 else d end + coalesce(f, 0) as d from a{i} a left join (select e.dst as id, sum(d * 0.85 / n) as f from e join a{i} x on x.id = e.src and d > 0.001 join o on o.src = e.src group by e.dst) m using (id))"
        for i in range(_MOST_ROUNDS)
    ),
]


@query("pagerank_active", _with("events", *_ACTIVE, final=f"select id, round(r, 6) as score from a{_MOST_ROUNDS} where (select max(d) from a{_MOST_ROUNDS}) <= 0.001"))
def _(spark, d):
    return rk.pagerank_active(fixtures.graph(spark, d, "events"), 0.001)[0].select("id", F.round("score", 6).alias("score"))


_HOPS = 30  # rounds of the SQL; shortest paths between parts and suppliers are much shorter
_BFS = ["h0 as materialized (select id, case when id % 100 = 0 then 0 end as d from v)", *(f"h{i + 1} as materialized (select h.id, coalesce(d, m) as d from h{i} h left join (select e.dst as id, min(d) + 1 as m from e join h{i} x on x.id = e.src and x.d = {i} group by e.dst) y using (id))" for i in range(_HOPS))]


@query("shortest_distances", _with("supppart", "s as (select src, dst from e union all select dst, src from e)", *(c.replace("from e join", "from s e join") for c in _BFS), final=f"select id, d::bigint as distance from h{_HOPS}"))
def _(spark, d):
    g = fixtures.graph(spark, d, "supppart")
    both = Graph(g.vertices, ends(g.edges, "either").select(F.col("id").alias("src"), F.col("other").alias("dst"), F.lit(1).alias("attr")))
    return rk.distances(both, g.vertices.where("id % 100 = 0"))[0]


def _ppr_exact_ctes(rounds: int, alpha: float = 0.15) -> list[str]:
    steps = ["o as (select src, count(*) as n from e group by src)", f"q0 as (select id as source, id as target, {alpha}::double as s from v)"]
    for i in range(rounds):
        steps.append(f"q{i + 1} as (select source, target, sum(s) as s from (select id as source, id as target, {alpha}::double as s from v union all select q.source, e.dst, q.s / o.n * {1 - alpha} from q{i} q join e on e.src = q.target join o on o.src = e.src) group by source, target)")
    return steps


@query("ppr_exact", _with("nation", *_ppr_exact_ctes(10), final="select source, target, round(s, 6) as score from q10"))
def _(spark, d):
    return rk.ppr_exact(fixtures.graph(spark, d, "nation"), 0.15, 10).select("source", "target", F.round("score", 6).alias("score"))


# --- components, cores, triangles, clustering ------------------------------------------------------------------------
# DuckDB follows the smallest label until nothing changes; Spark contracts the graph.
def _cc_ctes(edges: str = "se", vertices: str = "sv", tag: str = "c", rounds: int = 8) -> list[str]:
    steps = [f"b{tag} as materialized (select src as a, dst as b from {edges} union select dst, src from {edges})", f"{tag}0 as materialized (select id, id as l from {vertices})"]
    for i in range(rounds):
        n, m = f"{tag}{i}", f"{tag}{i}m"
        steps.append(f"{m} as materialized (select x.id, least(x.l, coalesce(min(y.l), x.l)) as l from {n} x left join b{tag} on a = x.id left join {n} y on y.id = b group by x.id, x.l)")
        steps.append(f"{tag}{i + 1} as materialized (select x.id, least(x.l, y.l) as l from {m} x join {m} y on y.id = x.l)")
    return steps


_CC_WHOLE = _cc_ctes("e", "v", "f")


@query("connected_components", _with("supppart", *_CC_WHOLE, final="select id, l as component from f8"))
def _(spark, d):
    return connected_components(fixtures.graph(spark, d, "supppart"))


@query("component_count", _with("supppart", *_CC_WHOLE, final="select count(distinct l) as n_components from f8"))
def _(spark, d):
    return component_count(connected_components(fixtures.graph(spark, d, "supppart")))


_SPARSE = 0.05
_CC = (_OCC, f"se as (select src, dst from o where {_U_EDGE} < {_SPARSE})", "sv as (select distinct unnest([src, dst]) as id from se)", *_cc_ctes())


@query("cc_fraction_wrong", _with("supppart", *_CC, *_cc_ctes("e", "v", "f"), final="select round(1 - avg((a.l = b.l)::int), 6) as fraction_wrong from c8 a left join f8 b using (id)"))
def _(spark, d):
    g = fixtures.graph(spark, d, "supppart")
    found = connected_components(sa.edge_sample(g, _SPARSE, SEED))
    return me.components_fraction_wrong(connected_components(g), found).select(F.round("fraction_wrong", 6).alias("fraction_wrong"))


def _label_ctes(op: str, k: int, rounds: int = 15) -> list[str]:
    steps = ["o as (select v.id, count(e.src) as d from v left join e on e.src = v.id group by v.id)", f"l0 as (select id, d, (d {op} {k})::int as l from o)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} as (select x.id, x.d, case when m is null then x.l else (x.d + m {op} {k})::int end as l from l{i} x left join (select e.dst, count(*) as m from e join l{i} y on y.id = e.src and y.l = 1 group by e.dst) z on z.dst = x.id)")
    return steps


@query("kcore_heuristic", _with("events", *_label_ctes(">=", 85), final="select id, l as label from l15"))
def _(spark, d):
    return rk.kcore_heuristic(fixtures.graph(spark, d, "events"), 85)


@query("kdegenerate_heuristic", _with("events", *_label_ctes("<=", 130), final="select id, l as label from l15"))
def _(spark, d):
    return rk.kdegenerate_heuristic(fixtures.graph(spark, d, "events"), 130)


_PEEL = (
    "u as materialized (select distinct src as id, dst as other from (select src, dst from e union all select dst, src from e) where src <> dst)",
    "k0 as materialized (select distinct id from u)",
    *(f"k{i + 1} as materialized (select id from u where id in (select id from k{i}) and other in (select id from k{i}) group by id having count(*) >= 80)" for i in range(25)),
)


@query("kcore_exact", _with("copurchase", *_PEEL, final="select id from k25"))
def _(spark, d):
    return rk.kcore(fixtures.graph(spark, d, "copurchase"), 80)


@query("kdegenerate_exact", _with("copurchase", *_PEEL, final="select id from v where id not in (select id from k25)"))
def _(spark, d):
    return rk.kdegenerate(fixtures.graph(spark, d, "copurchase"), 79)


_TRI = (
    "u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst)",
    "t as (select x.a, x.b, y.b as c from u x join u y on y.a = x.b join u z on z.a = x.a and z.b = y.b)",
    "n as (select id, count(*) as c from (select unnest([a, b, c]) as id from t) group by id)",
)


@query("triangle_count", _with("copurchase", *_TRI, final="select v.id, coalesce(c, 0) as triangles from v left join n on v.id = n.id"))
def _(spark, d):
    return cl.triangles(fixtures.graph(spark, d, "copurchase"))


@query("clustering_global", _with("copurchase", *_TRI, "g as (select id, count(*) as d from (select unnest([src, dst]) as id from e) group by id)", final="select v.id, round(case when d > 1 then 2.0 * coalesce(c, 0) / (d * (d - 1)) else 0 end, 6)::double as cc from v left join n on v.id = n.id left join g on v.id = g.id"))
def _(spark, d):
    return cl.global_clustering(fixtures.graph(spark, d, "copurchase")).select("id", F.round("cc", 6).alias("cc"))


def _local_ctes(direction: str, edges: str = "e", vertices: str = "v", tag: str = "") -> list[str]:
    ends = _ENDS[direction].replace(" from e", f" from {edges}")
    pairs = "count(*)" if direction == "either" else "count(distinct (least(u, w), greatest(u, w)))"
    share = "1 / (d * (d - 1)::double)" if direction == "either" else "1 / (d * (d - 1) / 2.0)"
    n, d, li = f"n{tag}", f"d{tag}", f"l{tag}"
    return [
        f"{n} as (select distinct * from ({ends}))",
        f"{d} as (select id, count(*) as d from {n} group by id)",
        f"{li} as (select id, {pairs} as l from (select a.id, a.other as u, b.other as w from {n} a join {n} b on b.id = a.other join {n} c on c.id = a.id and c.other = b.other) group by id)",
        f"lc{tag} as (select v.id, coalesce(d, 0) as degree, case when d > 1 then coalesce(l, 0)::double * ({share}) else 0 end as cc from {vertices} v left join {d} x on x.id = v.id left join {li} y on y.id = v.id)",
    ]


for _d in ("either", "in", "out"):
    query(f"clustering_local_{_d}", _with("events_simple", *_local_ctes(_d), final="select id, degree, round(cc, 6)::double as cc from lc"))(
        lambda s, d, k=_d: cl.local_clustering(fixtures.graph(s, d, "events_simple"), k).select("id", "degree", F.round("cc", 6).alias("cc"))
    )

query("clustering_by_degree", _with("events_simple", *_local_ctes("either"), final="select degree::double as degree, round(avg(cc), 6)::double as value from lc group by degree"))(
    lambda s, d: cl.clustering_by_degree(cl.local_clustering(fixtures.graph(s, d, "events_simple"))).select("degree", F.round("value", 6).alias("value"))
)


def _degree_stats(edges: str, vertices: str, tag: str) -> list[str]:
    return [
        f"n{tag} as (select distinct * from ({_ENDS['either'].replace(' from e', f' from {edges}')}))",
        f"d{tag} as (select v.id, count(other) as d from {vertices} v left join n{tag} n on n.id = v.id group by v.id)",
        f"h{tag} as (select d::double as degree, count(*) as c from d{tag} group by d)",
        f"s{tag} as (select degree, sum(c) over (order by degree) / row_number() over (order by degree)::double as value, sum(c) over (order by degree) / sum(c) over ()::double as cdf from h{tag})",
    ]


_STATS = (*_degree_stats("e", "v", "a"), _OCC, f"se as (select src, dst from o where {_U_EDGE} < {FRACTION})", "sv as (select distinct unnest([src, dst]) as id from se)", *_degree_stats("se", "sv", "b"), "df as (select abs(coalesce(x.value, 0) - coalesce(y.value, 0)) as d from sa x full join sb y using (degree))")


def _degree_pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = fixtures.graph(s, d, "events")
    return tuple(cl.degree_cumavg(cl.set_degrees(x)) for x in (g, sa.edge_sample(g, FRACTION, SEED)))


query("degree_cumavg", _with("events", *_STATS, final="select degree, round(value, 6) as value from sa"))(lambda s, d: _degree_pair(s, d)[0].select("degree", F.round("value", 6).alias("value")))
query("degree_cdf", _with("events", *_STATS, final="select degree, round(cdf, 6) as value from sa"))(lambda s, d: cl.degree_cdf(cl.set_degrees(fixtures.graph(s, d, "events"))).select("degree", F.round("value", 6).alias("value")))
query("norm_l1", _with("events", *_STATS, final="select round(avg(d), 6) as norm from df"))(lambda s, d: me.norm_mean(*_degree_pair(s, d)).select(F.round("norm", 6).alias("norm")))
query("norm_max", _with("events", *_STATS, final="select round(max(d), 6) as norm from df"))(lambda s, d: me.norm_max(*_degree_pair(s, d)).select(F.round("norm", 6).alias("norm")))


def _gcc(edges: str, vertices: str, tag: str) -> list[str]:
    return [
        f"u{tag} as (select distinct least(src, dst) as a, greatest(src, dst) as b from {edges} where src <> dst)",
        f"n{tag} as (select id, count(*) as c from (select unnest([x.a, x.b, y.b]) as id from u{tag} x join u{tag} y on y.a = x.b join u{tag} z on z.a = x.a and z.b = y.b) group by id)",
        f"g{tag} as (select id, count(*) as d from (select unnest([src, dst]) as id from {edges}) group by id)",
        f"cc{tag} as (select v.id, case when d > 1 then 2.0::double * coalesce(c, 0) / (d * (d - 1)) else 0 end as cc from {vertices} v left join n{tag} n on v.id = n.id left join g{tag} g on v.id = g.id)",
    ]


_TRIALS = [(f"k{t} as (select id from v where {uniform_sql(SEED + t, 'id')} < 0.4)", f"e{t} as (select src, dst from e where src in (select id from k{t}) and dst in (select id from k{t}))", *_gcc(f"e{t}", f"k{t}", str(t)), f"r{t} as (select {t} as trial, sum(abs(coalesce(w.cc, 0) - s.cc)) as l1 from cc{t} s left join ccw w using (id))") for t in range(4)]
query("best_of_n_node_sample", _with("events_simple", *_gcc("e", "v", "w"), *(c for t in _TRIALS for c in t), final=" union all ".join(f"select trial, round(l1, 6)::double as l1 from r{t}" for t in range(4))))(
    lambda s, d: wk.best_of_node_samples(fixtures.graph(s, d, "events_simple"), 0.4, 2, SEED).select("trial", F.round("l1", 6).alias("l1"))
)
query("l1_vertices", _with("events_simple", *_gcc("e", "v", "w"), *_TRIALS[0], final="select round(l1, 6)::double as l1 from r0"))(
    lambda s, d: me.l1_vertices(cl.global_clustering(sa.node_sample(fixtures.graph(s, d, "events_simple"), 0.4, SEED)), cl.global_clustering(fixtures.graph(s, d, "events_simple"))).select(F.round("l1", 6).alias("l1"))
)

# A share of all vertices is chosen; the least vertex outside enters, the least inside leaves.
_CHOSEN = (
    f"rn as (select id, row_number() over (order by {uniform_sql(SEED, 'id')}, id) as r, count(*) over () as c from v)",
    f"ch as (select id from rn where r <= floor(c * {FRACTION}))",
)
_SWAP = (
    *_CHOSEN,
    "iv as (select id from ch where id <> (select min(id) from ch) union all select min(id) from v where id not in (select id from ch))",
    "ie as (select src, dst from e where src in (select id from iv) and dst in (select id from iv))",
)


def _chosen(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = fixtures.graph(s, d, "events_simple")
    return g, sa.uniform_subset(g.vertices, FRACTION, SEED).select("id").persist()


def _swap(s: SparkSession, d: str) -> tuple[Graph, DataFrame, int, int]:
    g, chosen = _chosen(s, d)
    return g, chosen, g.vertices.join(chosen, "id", "left_anti").agg(F.min("id")).first()[0], chosen.agg(F.min("id")).first()[0]


query("swapped_degrees", _with("events_simple", *_SWAP, *_local_ctes("either", "ie", "iv"), final="select id, degree from lc"))(
    lambda s, d: (lambda g, c, added, removed: wk.swapped_degrees(g, cl.set_degrees(g, "either", c), c, added, removed))(*_swap(s, d))
)
query("swapped_coefficients", _with("events_simple", *_SWAP, *_local_ctes("either", "ie", "iv"), final="select id, degree, round(cc, 6)::double as cc from lc"))(
    lambda s, d: (lambda g, c, added, removed: wk.swapped_coefficients(g, cl.local_clustering(g, "either", c), c, added, removed).select("id", "degree", F.round("cc", 6).alias("cc")))(*_swap(s, d))
)
_INSIDE = (*_CHOSEN, "ie as (select src, dst from e where src in (select id from ch) and dst in (select id from ch))")
_BOTH_DEGREES = (*_degree_stats("e", "v", "a"), *_INSIDE, *_degree_stats("ie", "ch", "b"), "df as (select abs(coalesce(x.value, 0) - coalesce(y.value, 0)) as d from sa x full join sb y using (degree))")
_MEANS = [f"m{t} as (select degree, avg(cc) as value from lc{t} group by degree)" for t in "ab"]
_BOTH_CLUSTERING = (*_local_ctes("either", tag="a"), *_INSIDE, *_local_ctes("either", "ie", "ch", "b"), *_MEANS, "df as (select abs(coalesce(x.value, 0) - coalesce(y.value, 0)) as d from ma x full join mb y using (degree))")

query("subset_statistic", _with("events_simple", *_BOTH_DEGREES, final="select degree, round(value, 6) as value from sb"))(
    lambda s, d: (lambda g, c: wk.statistic(g, "either", wk.Evaluation.DEGREES, c).select("degree", F.round("value", 6).alias("value")))(*_chosen(s, d))
)
query("subset_norm_degrees", _with("events_simple", *_BOTH_DEGREES, final="select round(max(d), 6) as norm from df"))(lambda s, d: wk.subset_norm(*_chosen(s, d)).select(F.round("norm", 6).alias("norm")))
query("subset_norm_clustering", _with("events_simple", *_BOTH_CLUSTERING, final="select round(avg(d), 6) as norm from df"))(
    lambda s, d: wk.subset_norm(*_chosen(s, d), "either", wk.Evaluation.CLUSTERING).select(F.round("norm", 6).alias("norm"))
)
query("with_vertex_degree", _with("events_simple", *_INSIDE, *_local_ctes("either", "ie", "ch"), final="select id, degree from lc where id <> -1 union all select -1, 5"))(
    lambda s, d: (lambda g, c: wk.with_vertex(cl.set_degrees(g, "either", c), -1, degree=5))(*_chosen(s, d))
)
query("with_vertex_coefficient", _with("events_simple", *_INSIDE, *_local_ctes("either", "ie", "ch"), final="select id, degree, round(cc, 6)::double as cc from lc where id <> (select min(id) from ch) union all select min(id), 3, 0.5 from ch"))(
    lambda s, d: (lambda g, c: wk.with_vertex(cl.local_clustering(g, "either", c), c.agg(F.min("id")).first()[0], degree=3, cc=0.5).select("id", "degree", F.round("cc", 6).alias("cc")))(*_chosen(s, d))
)


@query("edges_of_vertex", _with("events", final="select src, dst from e where src = 7"))
def _(spark, d):
    return wk.edges_of(fixtures.edges(spark, d, "events"), 7)


@query("edges_of_vertices", _with("copurchase", final="select src, dst from e where src % 100 = 0"))
def _(spark, d):
    g = fixtures.graph(spark, d, "copurchase")
    with stored(g) as kept:
        return cut_lineage(kept.edges_of(g.vertices.where("id % 100 = 0")).select("src", "dst"))


@query("sorted_edges", _with("events", final="select src, dst from e order by src, dst"))
def _(spark, d):
    return wk.sorted_edges(fixtures.edges(spark, d, "events"))


@query("random_subset", _with("events_simple", "n as (select src as id, list_sort(list(dst)) as l from e group by src)", "x as (select id, l[i] as x, i - 1 as i from (select id, l, unnest(range(1, len(l) + 1)) as i from n))", f"r as (select id, x, row_number() over (partition by id order by {uniform_sql(SEED, 'x', 'i')}, x) as r from x)", final="select id, x from r where r <= 3"))
def _(spark, d):
    return sa.random_subsets(fixtures.edges(spark, d, "events_simple").select(F.col("src").alias("id"), F.col("dst").alias("x")), "id", "x", 3, SEED)


# --- walks ------------------------------------------------------------------------------------------------------------
_LENGTH, _THETA = 7, 3  # three segments of 3, 3 and 1 steps
_ETA = 3


def _numbered(direction: str) -> str:
    return f"nb as materialized (select id, other, row_number() over (partition by id order by other) - 1 as place, count(*) over (partition by id) as n from ({_ENDS[direction]}))"


def _segment_ctes() -> list[str]:
    steps = [_numbered("either"), f"w0 as materialized (select id as source, unnest(range(1, {_ETA + 1}))::int as seg, []::bigint[] as path, id as last from v)"]
    for j in range(1, _THETA + 1):
        moves = f"(seg < {_ETA} or {j} <= {_LENGTH - _THETA * (_LENGTH // _THETA)})"
        u = uniform_sql(SEED, "source", "seg", str(j))
        steps.append(f"w{j} as materialized (select source, seg, case when {moves} then list_append(path, b.other) else path end as path, case when {moves} then b.other else last end as last from w{j - 1} w join (select distinct id, n from nb) z on z.id = w.last join nb b on b.id = w.last and b.place = floor({u} * z.n))")
    return steps


_SQRT = ["t0 as materialized (select id as source, [id] as path, id as tail from v)"] + [f"t{i} as materialized (select t.source, list_concat(t.path, w.path) as path, w.last as tail from t{i - 1} t join w3 w on w.source = t.tail and w.seg = {i})" for i in range(1, _ETA + 1)]
_DOUBLE = [
    "b1 as (select a.source, a.seg, list_concat(a.path, z.path) as path, z.last as last from w3 a join w3 z on z.source = a.last and z.seg = 3 where a.seg = 1 union all select source, seg, path, last from w3 where seg = 2)",
    "b2 as (select a.source, list_concat(a.path, z.path) as path from b1 a join b1 z on z.source = a.last and z.seg = 2 where a.seg = 1)",
]
_PATH = "array_to_string(path, ',') as path"

query("walk_segments", _with("events", *_segment_ctes(), final=f"select source, seg, {_PATH}, last from w3"))(lambda s, d: wl.walk_segments(fixtures.graph(s, d, "events"), _LENGTH, _THETA, SEED).select("source", "seg", _joined("path"), "last"))
query("sqrt_walk", _with("events", *_segment_ctes(), *_SQRT, final=f"select source, {_PATH} from t3"))(lambda s, d: wl.sqrt_walk(fixtures.graph(s, d, "events"), _LENGTH, _THETA, SEED).select("source", _joined("path")))
query("doubling_walk", _with("events", *_segment_ctes(), *_DOUBLE, final="select source, array_to_string(list_prepend(source, path), ',') as path from b2"))(lambda s, d: wl.doubling_walk(fixtures.graph(s, d, "events"), _LENGTH, _THETA, SEED).select("source", _joined("path")))
query("walk_visit_counts", _with("events", *_segment_ctes(), *_DOUBLE, final="select source, target, count(*) as n from (select source, unnest(list_prepend(source, path)) as target from b2) group by source, target"))(
    lambda s, d: wl.visit_counts(wl.doubling_walk(fixtures.graph(s, d, "events"), _LENGTH, _THETA, SEED))
)

_PPR_BUDGET, _PPR_ALPHA = 20, 0.2
_LENGTHS = [geometric_value(uniform_value(SEED, "len", r), _PPR_ALPHA) for r in range(max(1, int(_PPR_ALPHA * _PPR_BUDGET)))]


def _ppr_ctes() -> list[str]:
    rounds = ", ".join(f"({r}, {n})" for r, n in enumerate(_LENGTHS))
    steps = [_numbered("out"), f"m0 as materialized (select id as source, r as round, k as steps, [id] as path, id as last from v, (values {rounds}) x(r, k))"]
    for j in range(1, max(_LENGTHS) + 1):
        u = uniform_sql(SEED, "source", "round", str(j))
        steps.append(f"m{j} as materialized (select source, round, steps, case when steps >= {j} and b.other is not null then list_append(path, b.other) else path end as path, case when steps >= {j} and b.other is not null then b.other else last end as last from m{j - 1} m left join (select distinct id, n from nb) z on z.id = m.last left join nb b on b.id = m.last and b.place = floor({u} * z.n))")
    return steps


query("ppr_monte_carlo", _with("nation", *_ppr_ctes(), final=f"select source, target, round(count(*) / {sum(_LENGTHS)}.0, 6)::double as score from (select source, unnest(path) as target from m{max(_LENGTHS)}) group by source, target"))(
    lambda s, d: wl.ppr_monte_carlo(fixtures.graph(s, d, "nation"), _PPR_BUDGET, _PPR_ALPHA, SEED).select("source", "target", F.round("score", 6).alias("score"))
)

query("ppr_monte_carlo_events", _with("events", *_ppr_ctes(), final=f"select source, target, round(count(*) / {sum(_LENGTHS)}.0, 6)::double as score from (select source, unnest(path) as target from m{max(_LENGTHS)}) group by source, target"))(
    lambda s, d: wl.ppr_monte_carlo(fixtures.graph(s, d, "events"), _PPR_BUDGET, _PPR_ALPHA, SEED).select("source", "target", F.round("score", 6).alias("score"))
)

# --- Bloom filter and scalars -----------------------------------------------------------------------------------------
_RATE, _HASHES = 0.01, 7  # false positives; hashes for that rate
_POS = "list_distinct([" + ", ".join(f"floor({uniform_sql(SEED, str(i), 'id')} * m)::bigint" for i in range(_HASHES)) + "])"
_BLOOM = _with("copurchase", f"m as (select ceil(-count(distinct src) * ln({_RATE}) / (ln(2) * ln(2)))::bigint as m from e)", f"p as (select id, unnest({_POS}) as pos from v, m)", "b as (select distinct pos from p where id in (select src from e))",
    final="select id, bool_and(b.pos is not null) as might_contain from p left join b using (pos) group by id")


def _sources(s: SparkSession, d: str) -> tuple[DataFrame, BloomFilter]:
    g = fixtures.graph(s, d, "copurchase")
    return g.vertices.select("id"), BloomFilter.sized(g.edges.select(F.col("src").alias("id")), _RATE, SEED)


@query("bloom_membership", _BLOOM)
def _(spark, d):
    ids, found = _sources(spark, d)
    return found.test(ids)


@query("bloom_round_trip", _BLOOM)
def _(spark, d):
    (ids, found), path = _sources(spark, d), _folder(spark, "bloom")
    found.save(path)
    return BloomFilter.load(spark, path, found.m, found.k, SEED).test(ids)


# DuckDB has no xxhash64, so the SQL tells what the filter is for: the ids that it must keep; tests hold the rate of the others.
@query("blocked_bloom_prefilter", _with("copurchase", f"k as (select id from v where {uniform_sql(SEED, 'id')} < {FRACTION})", final="select src, dst from e where src in (select id from k) and dst in (select id from k)"))
def _(spark, d):
    g = fixtures.graph(spark, d, "copurchase")
    return g.inside(g.vertices.where(uniform(SEED, "id") < FRACTION), prefilter=_RATE).select("src", "dst")


@query("blocked_bloom_round_trip", _with("copurchase", final="select id, true as might_contain from v where id in (select src from e)"))
def _(spark, d):
    g, path = fixtures.graph(spark, d, "copurchase"), _folder(spark, "bloom")
    sources = g.edges.select(F.col("src").alias("id"))
    found = BlockedBloom.sized(sources, _RATE, SEED)
    found.save(path)
    return BlockedBloom.load(spark, path, found.blocks, SEED).test(sources)


@query("date_texts", "select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') as at from events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.date_text(F.col("ts")).alias("at"))


@query("long_keys", "select event_id, printf('%016X', event_id) as key from events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.hex(scalars.long_key(F.col("event_id"))).alias("key"))


@query("exp_decay", "select event_id, round(value * exp(-0.01 * (event_id % 100)), 6) as decayed from events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(scalars.exponential_decay(F.col("value"), F.col("event_id") % 100, 0.01), 6).alias("decayed"))


_UE = uniform_sql(SEED, "event_id")


@query("geometric_draws", f"select event_id, (floor(ln(greatest({_UE}, 1e-300)) / ln(1 - 0.3)) + 1)::bigint as trials, (floor(ln(greatest({_UE}, 1e-300)) / ln(0.6)) + 1)::bigint as continued from events")
def _(spark, d):
    u = uniform(SEED, "event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geometric(u, 0.3).alias("trials"), geometric_continue(u, 0.6).alias("continued"))


@query("random_elements", _with("events", "n as (select src as id, list_sort(list(dst)) as l from e group by src)", final=f"select id, l[(floor({uniform_sql(SEED, 'id')} * len(l)) + 1)::int] as picked from n"))
def _(spark, d):
    return sa.random_elements(fixtures.edges(spark, d, "events").select(F.col("src").alias("id"), "dst"), "id", "dst", SEED)


# --- sequential samplers and the experiment ---------------------------------------------------------------------------
def _chain_sql(target: str, kind: str, home: bool, most: str) -> str:
    """The chains of _walk, one step a round: draws are hashes of (seed, sample, step, purpose). Its steps before `target` is met count."""
    u = lambda what, t="t", s="s": uniform_sql(SEED, s, t, f"'{what}'")
    jumped, away, stays = ("home", "case when x = home then k.id else home end", "home") if home else ("j.id", "k.id", "0")
    ctes = (
        "vs as materialized (select id, row_number() over (order by id) - 1 as rn, count(*) over () as c from v)",
        _numbered("out"),
        "dg as materialized (select distinct id, n from nb)",
        f"w as (select s, 0 as t, id as here, id as home, null::bigint as src, null::bigint as dst from (select unnest([0, 1]) as s) join vs on rn = floor({u('start', '0')} * c) union all "
        f"select s, t, coalesce(nb.other, {away}), case when nb.other is null then {away} else {stays} end, case when nb.other is not null then x end, nb.other from (select w.s, w.t + 1 as t, w.home, case when {u('jump', 'w.t + 1', 'w.s')} < 0.15 then {jumped} else here end as x "
        f"from w join vs j on j.rn = floor({u('to', 'w.t + 1', 'w.s')} * j.c) where w.t < {most}) z left join dg on dg.id = x left join nb on nb.id = x and nb.place = floor({u('step')} * dg.n) join vs k on k.rn = floor({u('sink')} * k.c))",
        "fe as (select s, src, dst, min(t) as t from w where dst is not null group by s, src, dst)",
        "fv as (select s, here as id, min(t) as t from w group by s, here)",
        f"ft as (select s, t, row_number() over (partition by s order by t) as r from {'fe' if kind == 'edge' else 'fv'})",
        f"st as (select s, t from ft where r = {target})",
    )
    rows = "select s as sample_id, 'edge' as kind, src, dst from fe join st using (s) where fe.t <= st.t union all select s, 'vertex', id, null from fv join st using (s) where fv.t <= st.t"
    return _with("events_simple", *ctes, final=rows).replace("with e as", "with recursive e as", 1)


_FIFTH = "(select floor(0.2 * count(*)) from e)"
query("random_walk_sample", _chain_sql(_FIFTH, "edge", True, f"(40 * {_FIFTH})"))(lambda s, d: wk.random_walk_sample(fixtures.graph(s, d, "events_simple"), 0.2, samples=2, seed=SEED))
query("random_jump_sample", _chain_sql(_FIFTH, "edge", False, f"(3 * {_FIFTH} + 100)"))(lambda s, d: wk.random_jump_sample(fixtures.graph(s, d, "events_simple"), 0.2, samples=2, seed=SEED))
query("random_jump_vertices", _chain_sql("(select floor(0.3 * count(*)) from v)", "vertex", False, "(select 2 * count(*) + 100 from v)"))(lambda s, d: wk.random_jump_vertices(fixtures.graph(s, d, "events_simple"), 0.3, samples=2, seed=SEED))
query("metropolis_run")(lambda s, d: wk.metropolis_sample(fixtures.graph(s, d, "events_simple"), 0.2, 20, 10.0, chains=2, seed=SEED))
_ROW = "select 'edge' as sampleType, 0.15::double as sampleFrac, 'pageRank' as queryAlgo, {} as metricName, ({})::double as metricScore, 1 as numSamples, 'first' as stitchStrategy"
query("experiment", _EDIT.replace("select edit_distance from ed", "", 1) + " " + _ROW.format("'edit distance'", "select edit_distance from ed") + " union all " + _ROW.format("'intersection'", "select count(*) from a where id in (select id from b)"))(lambda s, d: run_experiment(fixtures.graph(s, d, "copurchase"), "edge", FRACTION).select("sampleType", "sampleFrac", "queryAlgo", "metricName", "metricScore", "numSamples", "stitchStrategy"))


def _experiment_sql(fixture: str, ctes: tuple[str, ...], query_name: str, metric: str, score: str) -> str:
    row = f"select 'edge' as sampleType, {FRACTION}::double as sampleFrac, '{query_name}' as queryAlgo, '{metric}' as metricName, ({score})::double as metricScore, 1 as numSamples, 'first' as stitchStrategy"
    return _with(fixture, _OCC, f"se as (select src, dst from o where {_U_EDGE} < {FRACTION})", "sv as (select distinct unnest([src, dst]) as id from se)", *ctes, final=row)


def _experiment(s: SparkSession, d: str, fixture: str, query_name: str) -> DataFrame:
    rows = run_experiment(fixtures.graph(s, d, fixture), "edge", FRACTION, query_name)
    return rows.select("sampleType", "sampleFrac", "queryAlgo", "metricName", F.round("metricScore", 6).alias("metricScore"), "numSamples", "stitchStrategy")


query("experiment_components", _experiment_sql("supppart", (*_cc_ctes(), *_cc_ctes("e", "v", "f")), "connectedComponents", "fraction wrong", "select round(1 - avg((a.l = b.l)::int), 6) from c8 a left join f8 b using (id)"))(
    lambda s, d: _experiment(s, d, "supppart", "connectedComponents")
)
query("experiment_triangles", _experiment_sql("copurchase", (*_gcc("e", "v", "w"), *_gcc("se", "sv", "s")), "triangleCount", "mean absolute error", "select round(avg(abs(coalesce(x.c, 0) - coalesce(y.c, 0))), 6) from sv left join nw x using (id) left join ns y using (id)"))(
    lambda s, d: _experiment(s, d, "copurchase", "triangleCount")
)
