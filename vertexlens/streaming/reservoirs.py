"""A reservoir of fixed size for each vertex of an edge stream, kept by hash draws, so a stream and a batch choose the same edges."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vertexlens.functions.rng import uniform
from vertexlens.lineage import shared_folder
from vertexlens.operators.ranking import rank_within

_OUT = "id bigint, item bigint, seen bigint"
_STATE = "draws array<double>, items array<bigint>, seen bigint"


def reservoirs(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, item, seen) of a stream of rows(id, item), items distinct per id: after each trigger the k items of least draw of every id that has new ones.

    seen is how many items of the id have come so far; write it in update mode. State is k draws and items an id; a trigger's
    rows of an id go by in Arrow batches, of which k rows are kept.
    """

    def update(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        draws, items, seen = state.get if state.exists else ([], [], 0)
        held = list(zip(draws, items))
        for part in parts:
            held += zip(part["u"].tolist(), part["item"].tolist())
            seen += len(part)
            held = sorted(held)[:k]
        state.update(([u for u, _ in held], [x for _, x in held], seen))
        yield pd.DataFrame({"id": [key[0]] * len(held), "item": [x for _, x in held], "seen": [seen] * len(held)})

    drawn = rows.select("id", "item", uniform(seed, "id", "item").alias("u"))
    return drawn.groupBy("id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def latest(spark: SparkSession, updates: DataFrame, name: str) -> DataFrame:
    """(id, item) of the last update of every id of a stream that ends, run as far as there is input.

    Updates are written to the shared folder by trigger and read back; nothing of them goes through the driver.
    """
    path = shared_folder(spark, name)

    def put(batch: DataFrame, trigger: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/trigger={trigger}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/stream").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{_OUT}, trigger int").parquet(f"{path}/updates")
    last = rows.groupBy("id").agg(F.max("seen").alias("seen"))
    return rows.join(last, ["id", "seen"]).select("id", "item")


def batch_reservoirs(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, item): the same choice of a table."""
    return rank_within(rows.select("id", "item").withColumn("u", uniform(seed, "id", "item")), "id", F.col("u"), "u", "item").where(F.col("rank") <= k).select("id", "item")
