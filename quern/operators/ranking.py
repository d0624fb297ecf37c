"""Row numbers within keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 4096


def numbered_within(rows: DataFrame, key: str, order: str, name: str, run: int = RUN) -> DataFrame:
    """``name``: the row's number from 1 within its key by ``order``, a whole number.

    A key's rows are cut into runs of ``run`` order values. Only counts of runs are summed per key; rows are numbered
    inside their run, so no key meets in one task.
    """
    r = rows.withColumn("_run", F.floor(F.col(order) / run))
    counts = r.groupBy(key, "_run").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "_run", F.coalesce(F.sum("_k").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return r.withColumn("_n", place).join(before, [key, "_run"]).withColumn(name, (F.col("_before") + F.col("_n")).cast("bigint")).drop("_run", "_before", "_n")


def running_sum(rows: DataFrame, keys: list[str], order: str, coarse: Column, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over a key's rows up to and with this one, by ``order``.

    ``coarse`` never falls where ``order`` rises (an hour of a time, say). Sums of (key, coarse) are summed per key, rows are
    summed inside theirs: a key with a third of all rows is spread over as many tasks as it has coarse values.
    """
    r = rows.withColumn("_run", coarse).withColumn("_v", value.cast("bigint"))
    sums = r.groupBy(*keys, "_run").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_run", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_in", inside).join(before, [*keys, "_run"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_run", "_v", "_in", "_before")


def places(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``name``: the row's number from 0 within its group, by ``order``; any types, groups of any size.

    Rows are range-partitioned by group and order, so a large group lies in many partitions. What a partition holds of a group is
    counted; only those counts are summed per group. ``group`` columns must not be null (name null by a value of its own). Rows that agree in
    group and order meet in one task: end ``order`` with a column that tells repeats apart.
    """
    from quern.state import cut

    ranged = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))
    chunks = ranged.groupBy("_part", *group).agg(F.min("_at").alias("_start"), F.count("*").alias("_k"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    found = ranged.join(before, ["_part", *group]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_start"))
    return found.drop("_part", "_at", "_start", "_k", "_before")
