"""Events without a user or a time: the queries on them give what their SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry

USERS = [1, 2, None, 3, 1, 3, 2, None, None, 1, 2, 3]


@pytest.mark.parametrize("name", ["pagerank_active", "canonical_edges"])
def test_as_in_sql(spark, tmp_path, name):
    rows = ", ".join(f"({k}, {'null' if k in (1, 6) else k // 2}, {'null' if u is None else u})" for k, u in enumerate(USERS))
    path = tmp_path / "events.parquet"
    con = duckdb.connect()
    con.sql(f"copy (select event_id::bigint as event_id, make_timestamp(ts::bigint) as ts, user_id::bigint as user_id from (values {rows}) t(event_id, ts, user_id)) to '{path}'")
    con.sql(f"create view events as select * from '{path}'")
    order = lambda found: sorted(map(tuple, found), key=lambda r: [(x is None, x or 0) for x in r])
    want = order(con.sql(entry.oracle_sql()[name]).fetchall())
    assert want and order(entry.queries()[name](spark, str(tmp_path)).collect()) == want
