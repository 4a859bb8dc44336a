"""Dense 0-based row index within a file, without a per-file window.

``row_number() over (partition by file order by k)`` sends a whole file to one
task; one export may hold a third of all rows. Instead:

1. range-partition on (file, order keys) with a fixed partition count (AQE does
   not coalesce an explicit-count repartition, so partition ids are stable) and
   sort within partitions;
2. tag rows with (partition id, monotonically increasing id);
3. per (partition, file): first id and row count -- a table of at most
   ``#partitions + #files`` rows;
4. running sum of counts over the partitions of a file gives each block's base;
5. index = base + id - first id.

The order keys must be unique within a file so the order is total and a
recomputed task yields the same ids.

The range bounds come from a sample seeded by the RDD id, so two branches
planned separately (rows, block counts) would disagree on partition ids. The
tagged rows are therefore written once as a stage table in the session's
shared scratch folder (``spark.checkpoint.dir``), and both branches read it. So is the input: its splits, the sample
and the rows are three reads of it, and each would run the whole plan before it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeeforge.functions.joins import staged_side
from oeeforge.session import materialize


def with_file_row_index(
    df: DataFrame,
    file_col: str,
    order_cols: list[str],
    out_col: str = "_row_index",
    num_partitions: int | None = None,
) -> DataFrame:
    spark = df.sparkSession
    df = materialize(df, "row-index-input")
    # as many ranges as the input has splits (never fewer than the shuffle setting):
    # partition sizes follow spark.sql.files.maxPartitionBytes, not a fixed count
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    keys = [file_col, *order_cols]
    ranged = (
        df.repartitionByRange(n, *[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_ri_pid", F.spark_partition_id())
        .withColumn("_ri_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "row-index")
    blocks = ranged.groupBy(F.col("_ri_pid").alias("_rb_pid"), F.col(file_col).alias("_rb_file")).agg(
        F.min("_ri_mid").alias("_rb_first"), F.count(F.lit(1)).alias("_rb_n")
    )
    before = Window.partitionBy("_rb_file").orderBy("_rb_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_rb_base", F.coalesce(F.sum("_rb_n").over(before), F.lit(0)))
    blocks = staged_side(blocks, "row-index-blocks")  # at most #ranges + #files rows
    cond = (F.col("_ri_pid") == F.col("_rb_pid")) & F.col(file_col).eqNullSafe(F.col("_rb_file"))
    return ranged.join(blocks, cond).select(
        *[F.col(c) for c in df.columns],
        (F.col("_rb_base") + F.col("_ri_mid") - F.col("_rb_first")).cast("long").alias(out_col),
    )


def with_rank(df: DataFrame, keys: list[Column], out_col: str = "rank") -> DataFrame:
    """1-based rank of every row by ``keys`` (a total order), without sorting the table in one task."""
    names = [f"_rank_key_{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)) | {"_rank_of": F.lit("all")})
    ranked = with_file_row_index(keyed, "_rank_of", names, "_rank")
    return ranked.select(*df.columns, (F.col("_rank") + 1).alias(out_col))
