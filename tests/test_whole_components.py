import random

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from vertexlens.sources.fixtures import RIGHT


def brute(edges):
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {x: find(x) for x in label}


def test_components_of_every_edge(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(1, 200), r.randrange(1, 300)) for _ in range(220)]
    rows += [(300 + i, 400 + i + j) for i in range(4) for j in (0, 1)]  # a chain of 9 vertices
    pq.write_table(pa.table({"l_suppkey": pa.array([a for a, _ in rows], pa.int64()), "l_partkey": pa.array([b for _, b in rows], pa.int64())}), tmp_path / "lineitem.parquet")
    want = brute([(a, RIGHT + b) for a, b in rows])
    queries = entry.queries()
    got = queries["connected_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {x.id: x.component for x in got} == want
    assert queries["component_count"](spark, str(tmp_path)).first()[0] == len(set(want.values())) > 5
