"""Single-walker samplers and Metropolis subgraph sampling.

Both are sequential by nature: the next state depends on the last. One chain runs in one task, whose graph streams to it
in order and lies in mapped files of the task's local folder, whatever its size; the driver holds none of it. What is
distributed is the sorting of the graph, once for all chains, and the chains, by sample id.
"""

from __future__ import annotations

import enum
import os
import tempfile
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform_value
from vertexlens.graph import Direction, Graph, ends, neighbor_sets
from vertexlens.lineage import cut_lineage
from vertexlens.operators.clustering import degree_cumavg, global_clustering, local_clustering, set_degrees
from vertexlens.operators.metrics import NORMS, l1_vertices
from vertexlens.operators.sampling import node_sample
from vertexlens.operators.triangles import pack, unpack

#: Result rows of a chain that leave its task at a time, and links of a packed row.
_OUT_ROWS, _PACKED = 100_000, 100_000


def _file():
    """An unnamed file on the executor's own disk."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _blank(n: int, kind: type) -> np.ndarray:
    """n zeros in a mapped file: pages that the system can write out, not memory of the worker."""
    return np.asarray(np.memmap(_file(), kind, "w+", shape=(n,))) if n else np.zeros(0, kind)


class _Numbers:
    """Numbers put into a file, then mapped."""

    def __init__(self):
        self._file, self._n = _file(), 0

    def put(self, values: np.ndarray) -> None:
        self._file.write(values.astype(np.int64).tobytes())
        self._n += len(values)

    def mapped(self) -> np.ndarray:
        self._file.flush()
        return np.asarray(np.memmap(self._file, np.int64, "r", shape=(self._n,))) if self._n else np.zeros(0, np.int64)


class _Links:
    """Each vertex's targets, ascending: those of ids[i] are others[first[i]:first[i + 1]]. Links of no vertex in ids are dropped."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.first, self._others = ids, _blank(len(ids) + 1, np.int64), _Numbers()

    def put(self, a: np.ndarray, b: np.ndarray) -> None:
        at = np.searchsorted(self.ids, a)
        known = at < len(self.ids)
        known[known] = self.ids[at[known]] == a[known]
        places, n = np.unique(at[known], return_counts=True)
        self.first[places + 1] += n
        self._others.put(b[known])

    def close(self) -> _Links:
        np.cumsum(self.first, out=self.first)
        self.others = self._others.mapped()
        return self

    def get(self, v: int, default: set[int] | None = None) -> set[int]:
        i = int(np.searchsorted(self.ids, v))
        if i == len(self.ids) or self.ids[i] != v:
            return set() if default is None else default
        return set(self.others[self.first[i] : self.first[i + 1]].tolist())


def _packed(g: Graph, links: list[DataFrame], distinct: bool) -> DataFrame:
    """(kind, a0, b0, a1, b1, blob): vertices as kind 0, links as 1 and up, in packed runs told by their first and last pair.

    Sorted in parallel, by ranges; in order of all columns but the blob the runs are each kind in order of (a, b). With
    distinct, equal links are one: they meet in one range.
    """
    rows = g.vertices.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    for k, pairs in enumerate(links, 1):
        rows = rows.unionByName(pairs.toDF("a", "b").select(F.lit(k).alias("kind"), "a", "b"))
    most = _PACKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, last = -1, [], 0, None

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, last
            a, b = map(np.concatenate, zip(*held))
            if distinct and of:
                new = np.concatenate([[(of, a[0], b[0]) != last], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                last = of, a[-1], b[-1]
                a, b = a[new], b[new]
            held, size = [], 0
            if len(a):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([of], pa.int32())} | {c: [int(x)] for c, x in zip(("a0", "b0", "a1", "b1"), (a[0], b[0], a[-1], b[-1]))} | {"blob": pa.array([pack(a, b)], pa.binary())})

        for batch in batches:
            kind, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = (np.flatnonzero(np.diff(kind)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(kind)]):
                if i < j:
                    if held and (kind[i] != of or size >= most):
                        yield from full()
                    of = int(kind[i])
                    held.append((a[i:j], b[i:j]))
                    size += j - i
        if held:
            yield from full()

    rows = rows.repartitionByRange("kind", "a", "b").sortWithinPartitions("kind", "a", "b")
    return rows.mapInArrow(run, "kind int, a0 bigint, b0 bigint, a1 bigint, b1 bigint, blob binary")


def _chains(g: Graph, links: list[DataFrame], samples: int, run: Callable[..., Iterator[pa.RecordBatch]], schema: str, most_edges: int | None, distinct: bool = False) -> DataFrame:
    """The rows of run(sample, ids, *links) for each sample, with links(a, b) as _Links. A graph without vertices gives none."""
    if most_edges is not None and max(g.edges.limit(most_edges + 1).count(), g.vertices.limit(most_edges + 1).count()) > most_edges:
        raise ValueError(f"more than {most_edges} edges or vertices")
    rows = _packed(g, links, distinct).select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_id"), "*")
    rows = rows.repartitionById(samples, F.col("sample_id")).sortWithinPartitions("sample_id", "kind", "a0", "b0", "a1", "b1").select("sample_id", "kind", "blob")
    n_links = len(links)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, ids, found = None, None, []

        def close(upto: int) -> None:
            """The vertices are whole once links come; links of a kind are whole once the next kind comes."""
            nonlocal ids
            while len(found) < upto:
                if not found and isinstance(ids, _Numbers):
                    ids = ids.mapped()
                if found:
                    found[-1].close()
                found.append(_Links(ids))

        def ended() -> Iterator[pa.RecordBatch]:
            close(n_links)
            found[-1].close()
            return run(sample, ids, *found)

        for batch in batches:
            for s, kind, blob in zip(*batch.columns):
                s, kind = s.as_py(), kind.as_py()
                if sample != s:
                    if sample is not None:
                        yield from ended()
                    sample, ids, found = s, _Numbers(), []
                a, b = unpack(blob.as_buffer().to_pybytes(), 2)
                if kind == 0:
                    ids.put(a)
                else:
                    close(kind)
                    found[-1].put(a, b)
        if sample is not None:
            yield from ended()

    return rows.mapInArrow(each, schema)


def _walk(g: Graph, target: int, count: str, jump: float, home_moves: bool, every: int, samples: int, seed: int, most_edges: int | None) -> DataFrame:
    pairs = g.edges.select("src", "dst")
    if target > (pairs.distinct().count() if count == "edges" else g.vertices.count()):
        raise ValueError(f"target of {target} {count} cannot be reached")
    limit = 200 * (target + 10) + 20 * every
    names = ["sample_id", "kind", "src", "dst"]

    def out(sample: int, kind: str, src: np.ndarray, dst: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(src), sample)), pa.array([kind] * len(src), pa.string()), pa.array(src), pa.nulls(len(src), pa.int64()) if dst is None else pa.array(dst)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(sample: int, vertices: np.ndarray, links: _Links) -> Iterator[pa.RecordBatch]:
        """Vertices go by their place in order; an edge by the first place of its equals."""
        n, ids, first, dst = len(vertices), memoryview(vertices), memoryview(links.first), memoryview(links.others)
        seen_v, seen_e = _blank(n, np.uint8), _blank(len(dst), np.uint8)
        in_v, in_e = memoryview(seen_v), memoryview(seen_e)
        draw = lambda what, n: int(uniform_value(seed, sample, moved, what) * n)
        moved = 0
        here = home = draw("start", n)
        in_v[here] = 1
        n_v, n_e = 1, 0
        while (n_e if count == "edges" else n_v) < target:
            moved += 1
            if moved > limit:
                raise RuntimeError(f"{target} {count} not reached in {limit} steps: the walk cannot leave a part of the graph")
            if uniform_value(seed, sample, moved, "jump") < jump:
                here = home if home_moves else draw("to", n)
            if home_moves and moved % every == 0:
                home = draw("home", n) if here == home else here
                here = home
            a, z = first[here], first[here + 1]
            if z > a:
                edge = a + draw("step", z - a)
                nxt = dst[edge]
                if edge > a and dst[edge - 1] == nxt:
                    edge = bisect_left(dst, nxt, a, edge)
                if not in_e[edge]:
                    in_e[edge] = 1
                    n_e += 1
                here = bisect_left(ids, nxt)
                if here == n or ids[here] != nxt:
                    raise ValueError(f"an edge leads to {nxt}, which is no vertex")
            elif home_moves:  # a sink: home is left for good, as no step can leave it
                here = home = draw("sink", n) if here == home else home
            else:
                here = draw("sink", n)
            if not in_v[here]:
                in_v[here] = 1
                n_v += 1
        for i in range(0, len(dst), _OUT_ROWS):
            edges = i + np.flatnonzero(seen_e[i : i + _OUT_ROWS])
            if len(edges):
                yield out(sample, "edge", vertices[np.searchsorted(links.first, edges, side="right") - 1], links.others[edges])
        for i in range(0, n, _OUT_ROWS):
            yield out(sample, "vertex", vertices[i : i + _OUT_ROWS][seen_v[i : i + _OUT_ROWS] > 0], None)

    return _chains(g, [pairs], samples, run, "sample_id bigint, kind string, src bigint, dst bigint", most_edges)


def random_walk_sample(g: Graph, fraction: float, samples: int = 1, seed: int = 42, back: float = 0.15, jump_every: int = 100_000, most_edges: int | None = None) -> DataFrame:
    """(sample_id, kind, src, dst): a walk over out-edges until floor(fraction * |E|) distinct edges are traversed.

    Rows of kind `edge` are edges, of kind `vertex` visited vertices (src). With probability `back` the walk goes home
    before it steps; every jump_every steps home becomes the present place, or a random one if the walk is at home.
    """
    return _walk(g, int(fraction * g.edges.count()), "edges", back, True, jump_every, samples, seed, most_edges)


def random_jump_sample(g: Graph, fraction: float, samples: int = 1, seed: int = 42, jump: float = 0.15, most_edges: int | None = None) -> DataFrame:
    """As random_walk_sample, but with probability `jump` the walk jumps to a uniform vertex before it steps."""
    return _walk(g, int(fraction * g.edges.count()), "edges", jump, False, 1, samples, seed, most_edges)


def random_jump_vertices(g: Graph, fraction: float, samples: int = 1, seed: int = 42, jump: float = 0.15, most_edges: int | None = None) -> DataFrame:
    """As random_jump_sample until floor(fraction * |V|) distinct vertices are visited."""
    return _walk(g, int(fraction * g.vertices.count()), "vertices", jump, False, 1, samples, seed, most_edges)


def as_graph(rows: DataFrame, sample_id: int = 0) -> Graph:
    own = cut_lineage(rows.where(F.col("sample_id") == sample_id))  # vertices and edges are read from here: the chain runs once
    return Graph(own.where("kind = 'vertex'").select(F.col("src").alias("id"), F.lit(1).alias("attr")), own.where("kind = 'edge'").select("src", "dst", F.lit(1).alias("attr")))


class Evaluation(enum.Enum):
    CLUSTERING = "clustering"
    DEGREES = "degrees"


def _by_degree(members: dict[int, int], linked: dict[int, int], direction: Direction, evaluation: Evaluation) -> dict[int, float]:
    """degree -> value, from the members of each degree and the sum of their linked pairs."""
    if evaluation is Evaluation.CLUSTERING:
        pairs = lambda d: d * (d - 1) / (1 if direction == "either" else 2)
        return {d: linked[d] / pairs(d) / n if d > 1 else 0.0 for d, n in members.items()}
    out, total = {}, 0
    for j, d in enumerate(sorted(members), 1):
        total += members[d]
        out[d] = total / j
    return out


class _Subset:
    """A vertex set's statistic, kept up to date under swaps: a swap looks at the two vertices' neighbourhoods only.

    Per degree it has the number of members and the sum of their linked pairs, both whole numbers, so nothing drifts.
    """

    def __init__(self, chosen: set[int], adj: dict[int, set[int]] | _Links, back: dict[int, set[int]] | _Links, direction: str, evaluation: Evaluation):
        self.chosen, self.adj, self.back, self.direction, self.evaluation = set(chosen), adj, back, direction, evaluation
        self.members: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        self.own = {v: self._of(v) for v in self.chosen}
        for x in self.own.values():
            self._count(x, 1)

    def _of(self, v: int) -> tuple[int, int]:
        """(degree, linked pairs) of a member."""
        near = self.adj.get(v, set()) & self.chosen
        if self.evaluation is not Evaluation.CLUSTERING or len(near) < 2:
            return len(near), 0
        pairs = ((u, w) for u in near for w in self.adj.get(u, set()) & near)
        return len(near), sum(1 for _ in pairs) if self.direction == "either" else len({(min(p), max(p)) for p in pairs})

    def _count(self, x: tuple[int, int], sign: int) -> None:
        d, linked = x
        self.members[d] = self.members.get(d, 0) + sign
        self.linked[d] = self.linked.get(d, 0) + sign * linked
        if not self.members[d]:
            del self.members[d], self.linked[d]

    def swap(self, leaves: int, enters: int) -> None:
        """A member can only have changed if it has one of the two as a neighbour."""
        self.chosen.remove(leaves)
        self.chosen.add(enters)
        self._count(self.own.pop(leaves), -1)
        touched = (self.back.get(leaves, set()) | self.back.get(enters, set())) & self.chosen - {enters}
        for v in touched:
            self._count(self.own[v], -1)
        for v in (*touched, enters):
            self.own[v] = self._of(v)
            self._count(self.own[v], 1)

    def statistic(self) -> dict[int, float]:
        return _by_degree(self.members, self.linked, self.direction, self.evaluation)


def _norm(a: dict[int, float], b: dict[int, float], evaluation: Evaluation) -> float:
    diff = [abs(a.get(d, 0.0) - b.get(d, 0.0)) for d in {*a, *b}]
    if not diff:
        return 0.0
    return sum(diff) / len(diff) if evaluation is Evaluation.CLUSTERING else max(diff)


def _coefficients(g: Graph, direction: Direction) -> dict[int, float]:
    """The graph's own coefficients: a row for each degree comes to the driver, with whole numbers, so it equals _Subset's to the bit."""
    pairs = F.col("degree") * (F.col("degree") - 1) / (1 if direction == "either" else 2)
    found = local_clustering(g, direction).groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("cc") * pairs).cast("bigint")).alias("linked")).collect()
    return _by_degree({r["degree"]: r["n"] for r in found}, {r["degree"]: r["linked"] for r in found}, direction, Evaluation.CLUSTERING)


def metropolis_sample(g: Graph, fraction: float, iterations: int, power: float, direction: Direction = "either", evaluation: Evaluation = Evaluation.DEGREES, chains: int = 1, seed: int = 42, most_edges: int | None = None) -> DataFrame:
    """(sample_id, id, norm): per chain the best vertex set of floor(fraction * |V|) met, and its distance to the graph.

    A move swaps a member for an outsider and is accepted with probability (old / new) ** power. An empty set has no rows.
    """
    links = [ends(g.edges, d) for d in ([direction] if direction == "either" else [direction, "in" if direction == "out" else "out"])]
    known = _coefficients(g, direction) if evaluation is Evaluation.CLUSTERING else None

    def run(sample: int, ids: np.ndarray, adj: _Links, back: _Links | None = None) -> Iterator[pa.RecordBatch]:
        full = known
        if full is None:
            degree, n = np.unique(np.diff(adj.first), return_counts=True)
            full = _by_degree(dict(zip(degree.tolist(), n.tolist())), {}, direction, evaluation)
        r, size = np.random.default_rng([seed, sample]), int(fraction * len(ids))
        order = r.permutation(ids)
        inside, outside = order[:size], order[size:]
        now = _Subset(set(inside.tolist()), adj, back or adj, direction, evaluation)
        old = best = _norm(now.statistic(), full, evaluation)
        top = set(now.chosen)
        for _ in range(iterations if len(inside) and len(outside) else 0):
            i, j = int(r.integers(len(inside))), int(r.integers(len(outside)))
            leaves, enters = int(inside[i]), int(outside[j])
            now.swap(leaves, enters)
            new = _norm(now.statistic(), full, evaluation)
            if new <= 0 or r.random() < (old / new) ** power:
                old = new
                inside[i], outside[j] = enters, leaves
                if new < best:
                    best, top = new, set(now.chosen)
            else:
                now.swap(enters, leaves)
        found = np.fromiter(sorted(top), np.int64, len(top))
        for i in range(0, len(found), _OUT_ROWS):
            part = found[i : i + _OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sample)), pa.array(part), pa.array(np.full(len(part), best))], ["sample_id", "id", "norm"])

    return _chains(g, links, chains, run, "sample_id bigint, id bigint, norm double", most_edges, distinct=True)


def statistic(g: Graph, direction: Direction, evaluation: Evaluation, chosen: DataFrame | None = None) -> DataFrame:
    """(degree, value) as DataFrame operators compute it, for graphs of any size; with chosen(id), of that subset."""
    from vertexlens.operators.clustering import clustering_by_degree

    if evaluation is Evaluation.CLUSTERING:
        return clustering_by_degree(local_clustering(g, direction, chosen))
    return degree_cumavg(set_degrees(g, direction, chosen))


def subset_norm(g: Graph, chosen: DataFrame, direction: Direction = "either", evaluation: Evaluation = Evaluation.DEGREES) -> DataFrame:
    """One row (norm): the distance between the subset's statistic and the graph's."""
    return NORMS[evaluation.value](statistic(g, direction, evaluation, chosen), statistic(g, direction, evaluation))


def swapped_degrees(g: Graph, degrees: DataFrame, chosen: DataFrame, added: int, removed: int, direction: Direction = "either") -> DataFrame:
    """degrees(id, degree) of chosen(id) after `removed` leaves and `added` enters, from the two vertices' edges alone."""
    rows = neighbor_sets(g.edges, direction)
    stays = chosen.where(F.col("id") != removed).select("id")
    # v's degree counts its neighbours inside: one less for those that have `removed` as one, one more for `added`
    touched = rows.where(F.col("other").isin(added, removed)).select("id", F.when(F.col("other") == added, 1).otherwise(-1).alias("degree"))
    old = degrees.where(F.col("id") != removed).select("id", F.col("degree").cast("bigint").alias("degree"))
    inside = stays.unionByName(stays.sparkSession.range(1).select(F.lit(added).cast("bigint").alias("id")))
    new = rows.where(F.col("id") == added).join(inside.withColumnRenamed("id", "other"), "other", "left_semi").agg(F.count(F.lit(1)).alias("degree")).select(F.lit(added).cast("bigint").alias("id"), "degree")
    changed = touched.join(stays, "id", "left_semi").select("id", F.col("degree").cast("bigint").alias("degree"))
    return old.unionByName(changed).unionByName(new).groupBy("id").agg(F.sum("degree").alias("degree"))


def swapped_coefficients(g: Graph, coefficients: DataFrame, chosen: DataFrame, added: int, removed: int, direction: Direction = "either") -> DataFrame:
    """local_clustering of the swapped set, recomputed only where a neighbourhood can have changed.

    That is at `added`, at members with either vertex in their neighbour set, and at no others.
    """
    own = g.vertices.sparkSession.range(1).select(F.lit(added).cast("bigint").alias("id"))
    inside = chosen.select("id").where(F.col("id") != removed).unionByName(own)
    near = cut_lineage(neighbor_sets(g.edges, direction).where(F.col("other").isin(added, removed)).select("id").unionByName(own).distinct())
    # their coefficients need their neighbours, and the edges between those, and no others
    around = neighbor_sets(g.edges, direction).join(near, "id", "left_semi").select(F.col("other").alias("id")).unionByName(near).distinct()
    fresh = local_clustering(g, direction, cut_lineage(inside.join(around, "id", "left_semi"))).join(near, "id", "left_semi")
    return coefficients.where(F.col("id") != removed).join(near, "id", "left_anti").unionByName(fresh)


def with_vertex(rows: DataFrame, vertex: int, **values: float) -> DataFrame:
    """rows(id, ...) with one vertex's row put in or replaced."""
    one = rows.sparkSession.range(1).select(*(F.lit(vertex if c == "id" else values[c]).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return rows.where(F.col("id") != vertex).unionByName(one)


def best_of_node_samples(g: Graph, fraction: float, trials: int, seed: int = 42) -> DataFrame:
    """(trial, l1): 1 + trials + 1 node samples by their L1 distance in clustering to the graph; the smallest is the sample to take."""
    truth = global_clustering(g).persist()
    rows = None
    for t in range(trials + 2):
        one = l1_vertices(global_clustering(node_sample(g, fraction, seed + t)), truth).select(F.lit(t).alias("trial"), "l1")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def best_node_sample(g: Graph, fraction: float, trials: int, seed: int = 42) -> Graph:
    best = best_of_node_samples(g, fraction, trials, seed).orderBy("l1", "trial").first()["trial"]
    return node_sample(g, fraction, seed + best)


def signatures(g: Graph) -> DataFrame:
    """(id, in_degree) of every vertex, 0 included; order by in_degree, id to get them ascending."""
    from vertexlens.graph import degrees_with_zero

    return degrees_with_zero(g, "in").withColumnRenamed("degree", "in_degree")


def edges_of(edges: DataFrame, vertex: int) -> DataFrame:
    """The out-edges of one vertex: the filter reaches the scan."""
    return edges.where(F.col("src") == vertex)


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")
