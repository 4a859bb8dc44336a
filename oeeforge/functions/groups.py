"""Aggregates over many small groups.

An exact mean's buffer is several times the value that it adds up. Where a group has a few rows, combining on the map side ships
such a buffer for nearly every row and fills the tasks' hash tables, so that they spill. ``aggregate`` ships the rows of
ordinary groups as they are, in as many tasks as their number asks for; only groups of more rows than a task should get (and
the groups that share a hash bucket with one) are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeeforge.functions.joins import staged_side

#: Rows that a task gets, and from which on a group is combined on the map side.
ROWS_PER_TASK = 500_000
#: Buckets of groups per task: a bucket of ordinary groups has a small part of a task's rows.
BUCKETS_PER_TASK = 16


def aggregate(rows: DataFrame, keys: list[str], aggs: list[Column], counted: DataFrame | None = None) -> DataFrame:
    """``rows.groupBy(*keys).agg(*aggs)``. ``counted``: where it is cheaper to read, a table with as many rows of each group."""
    counted = rows if counted is None else counted
    n = counted.count()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_TASK))
    if n <= ROWS_PER_TASK:
        return rows.repartition(tasks, *keys).groupBy(*keys).agg(*aggs)
    # groups of many rows make their bucket large: buckets are counted, a few rows of each task, not the groups
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS_PER_TASK * tasks))
    sizes = counted.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    large = staged_side(sizes.where(F.col("_n") > ROWS_PER_TASK).select("_bucket"), "large-buckets")
    if large.isEmpty():
        return rows.repartition(tasks, *keys).groupBy(*keys).agg(*aggs)
    dealt = rows.withColumn("_bucket", bucket)
    few = dealt.join(large, "_bucket", "left_anti").repartition(tasks, *keys).groupBy(*keys).agg(*aggs)
    return few.unionByName(dealt.join(large, "_bucket", "left_semi").groupBy(*keys).agg(*aggs))
