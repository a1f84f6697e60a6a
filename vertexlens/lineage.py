"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: With it, Spark deletes an execution's shuffle files at its end: what is checkpointed needs them no longer.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _with_folder(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors see, for files that a job writes and reads back."""
    _with_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so lost executors cost no recomputation.

    The folder is spark.checkpoint.dir; only where that is unset (single-machine tests) one under the warehouse.
    """
    _with_folder(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # select: a new execution, which takes the setting


def cut_and_observe(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut_lineage(df), and aggregates of its rows that the writing job takes as they pass: no job of their own.

    A task that is run again after a loss counts once, as the driver merges what each partition's finished task tells.
    """
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *(c.alias(name) for name, c in metrics.items())))
    return cut, seen.get


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as Parquet in the shared folder, read back, for as long as the context lasts: smaller than a checkpoint where columns compress."""
    spark = df.sparkSession
    path = shared_folder(spark, f"table-{uuid.uuid4().hex}")
    with _shuffles_dropped(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
