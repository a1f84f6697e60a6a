"""Splitting vertices into sparse and dense by degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centres(degrees: DataFrame) -> DataFrame:
    """One row (lo, hi): the exact optimum of 2-means on the degrees; null where there is only one distinct degree.

    Works on the histogram of degrees, which has at most about sqrt(2 |E|) rows: every cut between two degrees is
    scored by prefix sums; of equal scores the lowest cut counts.
    """
    h = degrees.groupBy("degree").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("s", F.col("n") * F.col("degree"))
    up = Window.orderBy("degree")
    whole = Window.partitionBy()
    cuts = h.select("degree", F.sum("n").over(up).alias("n1"), F.sum("s").over(up).alias("s1"), F.sum("n").over(whole).alias("n0"), F.sum("s").over(whole).alias("s0")).where("n1 < n0")
    score = F.col("s1") * F.col("s1") / F.col("n1") + (F.col("s0") - F.col("s1")) * (F.col("s0") - F.col("s1")) / (F.col("n0") - F.col("n1"))
    best = cuts.select(score.alias("score"), "degree", (F.col("s1") / F.col("n1")).alias("lo"), ((F.col("s0") - F.col("s1")) / (F.col("n0") - F.col("n1"))).alias("hi"))
    top = best.agg(F.max(F.struct("score", (-F.col("degree")).alias("low"), "lo", "hi")).alias("b"))
    return top.select("b.lo", "b.hi")


def split_by_degree(degrees: DataFrame, method: str = "exact", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sparse, dense) of degrees(id, degree): sparse is strictly nearer to the lower centre; one distinct degree is all dense.

    method 'mllib' takes the centres of a seeded Lloyd iteration instead, which may stop short of the optimum.
    """
    if method == "exact":
        c = centres(degrees)
    elif method == "mllib":
        c = _lloyd(degrees, seed)
    else:
        raise ValueError(f"method {method!r}: 'exact' or 'mllib'")
    marked = degrees.join(F.broadcast(c)).withColumn("sparse", F.coalesce(F.abs(F.col("degree") - F.col("lo")) < F.abs(F.col("degree") - F.col("hi")), F.lit(False)))
    return marked.where("sparse").select("id", "degree"), marked.where("not sparse").select("id", "degree")


def _lloyd(degrees: DataFrame, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["degree"], outputCol="features").transform(degrees)
    found = sorted(float(v[0]) for v in KMeans(k=2, maxIter=30, seed=seed).fit(x).clusterCenters())
    row = (found[0], found[1]) if len(found) == 2 else (None, None)
    return degrees.sparkSession.createDataFrame([row], "lo double, hi double")
