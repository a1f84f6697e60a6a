import datetime

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_the_set_grows_with_the_vertices(spark, tmp_path):
    ids = [(7 * k * k + k) % 400 for k in range(3000)]
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k) for k in range(3000)]
    pq.write_table(pa.table({"event_id": list(range(3000)), "user_id": ids, "ts": at}), tmp_path / "events.parquet")
    vertices = {x for a, b in zip(ids, ids[1:]) if a != b for x in (a, b)}
    got = {r.id for r in entry.queries()["swapped_degrees"](spark, str(tmp_path)).collect()}
    assert got <= vertices and len(got) == int(0.15 * len(vertices)) and max(got) > 100
