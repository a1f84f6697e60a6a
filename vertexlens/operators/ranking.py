"""Exact ranks and k-smallest selections that never put one key, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task may rank; a larger key is ranked in slices.
HUB_ROWS = 1_000_000
#: Slices of the unit interval for k-smallest selections: the size of the driver-side-free histogram.
SLICES = 4096


def occurrences(edges: DataFrame) -> DataFrame:
    """edges with occ, a number from 1 for each of the equal rows (src, dst, attr); equal rows need no order, so counts suffice."""
    counts = edges.groupBy("src", "dst", "attr").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("src", "dst", "attr", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("occ"))


def rank_within(rows: DataFrame, key: str, slice_of: Column | None, *order: str, hub_rows: int | None = None) -> DataFrame:
    """rows with rank (from 1) and n, the rows of the key. slice_of is in [0, 1) and agrees with the order where it decides.

    Keys of up to hub_rows (HUB_ROWS) rows are ranked by a window in order of `order`. A larger key is ranked in slices of
    about that size, whose first ranks are the cumulated slice counts. Without slice_of they are cut at approximate
    quantiles of the first column of the order, so the ranks are the same whatever the size.
    """
    hub_rows = hub_rows or HUB_ROWS
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(counts, key)
    hubs = counts.where(F.col("n") > hub_rows)
    most = hubs.agg(F.max("n")).first()[0]
    if most is None:
        return joined.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    if slice_of is None:
        pieces = min(1000, -(-most // hub_rows))
        cuts = rows.join(hubs.select(key), key, "left_semi").groupBy(key).agg(F.percentile_approx(order[0], [i / pieces for i in range(1, pieces)] or [0.5]).alias("_cuts"))
        cut = joined.join(cuts, key, "left").withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order[0]))), F.lit(0)).cast("bigint")).drop("_cuts")
    else:
        cut = joined.withColumn("_slice", F.floor(slice_of * F.ceil(F.col("n") / hub_rows)).cast("bigint"))
    sizes = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_slice", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))
    return cut.withColumn("_own", own).join(sizes, [key, "_slice"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_slice")


def smallest(rows: DataFrame, u: str, share: float, *ties: str) -> DataFrame:
    """The floor(share * rows) rows of least u (in [0, 1), then ties): an exact uniform subset if u is a draw.

    A histogram of SLICES counts finds the slice that holds the boundary; only that slice's rows are ordered.
    """
    cut = rows.withColumn("_slice", F.floor(F.col(u) * SLICES).cast("int"))
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("m"))
    everything = Window.orderBy("_slice")  # at most SLICES rows
    total = F.sum("m").over(Window.partitionBy())
    sizes = sizes.select("_slice", (F.floor(total * share) - F.coalesce(F.sum("m").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"), "m")
    marked = cut.join(F.broadcast(sizes), "_slice").where("left > 0")
    inside = marked.where("left >= m")
    edge = marked.where("left < m").withColumn("_at", F.row_number().over(Window.partitionBy("_slice").orderBy(u, *ties))).where("_at <= left")
    return inside.drop("_slice", "m", "left").unionByName(edge.drop("_slice", "m", "left", "_at"))


#: Rows of the slice that holds a boundary, beyond which the slice is cut again, and how often it may be.
_EDGE_ROWS, _CUTS = 100_000, 6


def least_within(rows: DataFrame, key: str, by: str, wanted: dict, *ties: str) -> DataFrame:
    """Of each key's rows the wanted[key] of least `by` (a finite double, then ties), all if there are fewer; other keys have none.

    by may be of any distribution: the values between a key's least and greatest are cut into SLICES, the slice that holds the
    boundary is cut again while it has many rows, and only that slice's rows are ordered, by one task a key. Keys are few (layers, say): a
    row of bounds each comes to the driver, and SLICES counts each stay on the executors.
    """
    found = rows.groupBy(key).agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    # what is below lo is in; the boundary is in [lo, hi], whose n rows give the `left` that are still wanted
    bounds = {r[key]: (r["lo"], r["hi"], wanted.get(r[key], 0), r["n"]) for r in found}
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, lo double, hi double, left bigint"
    spark = rows.sparkSession
    for _ in range(_CUTS):
        wide = [(k, lo, hi, left) for k, (lo, hi, left, n) in bounds.items() if 0 < left < n and n > _EDGE_ROWS and lo < hi]
        if not wide:
            break
        held = rows.join(F.broadcast(spark.createDataFrame(wide, schema)), key).where(F.col(by).between(F.col("lo"), F.col("hi")))
        at = F.least(F.lit(SLICES - 1), F.floor((F.col(by) - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLICES)).cast("int")
        sizes = held.groupBy(key, "left", at.alias("_slice")).agg(F.count(F.lit(1)).alias("m"), F.min(by).alias("lo"), F.max(by).alias("hi"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = sizes.withColumn("before", before).where("before < left and left <= before + m").collect()
        for r in cut:
            bounds[r[key]] = (r["lo"], r["hi"], r["left"] - r["before"], r["m"])
    # all n rows are wanted: those below the greatest are in, and of those as great as it all are
    last = spark.createDataFrame([(k, hi if left >= n else lo, hi, min(left, n)) for k, (lo, hi, left, n) in bounds.items() if left > 0], schema)
    marked = rows.join(F.broadcast(last), key).where(F.col(by) <= F.col("hi"))
    inside = marked.where(F.col(by) < F.col("lo")).select(rows.columns)
    edge = marked.where(F.col(by) >= F.col("lo")).withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(by, *ties))).where("_at <= left")
    return inside.unionByName(edge.select(rows.columns))


def least_rows(rows: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n rows of least `by` (then ties), all if there are fewer."""
    return least_within(rows.withColumn("_all", F.lit(0)), "_all", by, {0: n}, *ties).drop("_all")


#: Rows of a partition that monotonically_increasing_id can count.
_PLACE_BITS = 33


def dense_numbers(rows: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """rows with number: 0 .. n - 1 in order of the columns, checkpointed; rows that are equal in all of them are in an arbitrary but fixed order.

    One sort, by ranges (`parts` of them, if given): a partition's rows follow the numbers of the partitions before it, whose sizes are summed up. No
    window is over all rows, and no task holds them.
    """
    from vertexlens.lineage import cut_lineage

    ranges = rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)
    placed = cut_lineage(ranges.sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_m"))  # a row a partition
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_part", "_before", "_at")
