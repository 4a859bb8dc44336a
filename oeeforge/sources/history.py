"""History table scans.

The history is a Parquet table partitioned by ``batch_id``; Spark prunes
columns and pushes predicates down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.functions.files import path_exists


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The whole history (callers ``select`` what they need; Catalyst prunes)."""
    return spark.read.schema(S.HISTORY_SCHEMA).parquet(path)


def analysis_columns(history: DataFrame) -> DataFrame:
    """The 13 columns the analyses read."""
    return history.select(*S.ANALYSIS_COLUMNS)


def stored_keys(history: DataFrame, exclude_batch: str | None = None) -> DataFrame:
    """The keys already stored (optionally without one batch, for a retried load)."""
    h = history if exclude_batch is None else history.filter(F.col("batch_id") != F.lit(exclude_batch))
    return h.select(*S.KEY_COLUMNS)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a history? Only a missing path means no; a damaged or unreachable one raises when it is read."""
    return path_exists(spark, path)
