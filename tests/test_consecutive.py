"""Consecutive events: one order over all of them, however many share an hour or a moment."""

import datetime as dt
import random

from vertexlens.sources.fixtures import consecutive


def test_every_event_looks_to_the_next(spark):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=r.choice([0, 0, 1, 5000, 90_000]) if i < 150 else 7200), r.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").repartition(6)
    users = [u for _, _, u in sorted(rows, key=lambda e: (e[1], e[0]))]
    assert sorted(map(tuple, consecutive(df).collect())) == sorted(zip(users, users[1:]))
    assert consecutive(df.where("event_id = 3")).count() == 0 and consecutive(df.where("false")).count() == 0
    plan = consecutive(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead" not in plan
