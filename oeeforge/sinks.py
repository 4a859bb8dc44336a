"""Report and table sinks (K1-K7).

Reports are written as JSON-lines folders (one file per task, no driver
collection); tables as Parquet. Writes of the history and the import log
overwrite only their own ``batch_id`` partition, so a retried batch rewrites
the same result and other batches are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeeforge.functions.files import delete_path, path_exists


def write_json(df: DataFrame, path: str) -> str:
    """K1-K5: a report table as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def write_quality_report(findings: DataFrame, counts: DataFrame, path: str) -> str:
    """K1: findings and per-file severity counts."""
    write_json(findings, f"{path}/findings")
    write_json(counts, f"{path}/counts")
    return path


def write_metrics_report(metrics: DataFrame, path: str) -> str:
    """K2: couple metrics with their conclusions, and how many couples there are."""
    write_json(metrics, f"{path}/metrics")
    write_json(metrics.agg(F.count(F.lit(1)).alias("n_couples")), f"{path}/summary")
    return path


def write_outlier_report(outliers: DataFrame, short: DataFrame, path: str) -> str:
    """K3: outliers (numbers rounded to 2 dp for the report) and short-history couples."""
    rounded = outliers.select(
        *[F.round(c, 2).alias(c) if c in ("value", "group_mean", "group_std", "z_score") else F.col(c)
          for c in outliers.columns])
    write_json(rounded, f"{path}/outliers")
    write_json(short, f"{path}/short_history")
    return path


def write_recommendation_report(recs: DataFrame, path: str) -> str:
    """K4: the recommendations as the report shows them (``recommend.report_values``)."""
    return write_json(recs, path)


def write_ml_report(cv: DataFrame, importance: DataFrame, examples: DataFrame, path: str) -> str:
    """K5: CV scores, global importance, example predictions with their intervals and explanations."""
    write_json(cv, f"{path}/cv")
    write_json(importance, f"{path}/importance")
    write_json(examples, f"{path}/examples")
    return path


def write_to_fix_csv(to_fix: DataFrame, path: str) -> str:
    """K6: to-fix list as CSV with a header (UTF-8; no byte-order mark)."""
    to_fix.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_partition(df: DataFrame, path: str, partition_col: str = "batch_id", value: str | None = None) -> str:
    """K7: append/replace only the partitions present in ``df`` (dynamic overwrite).

    ``value``: the one partition that ``df`` is meant to be; an empty ``df`` clears it (a dynamic overwrite alone leaves it).
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))
    if value is not None:
        from urllib.parse import quote

        spark = df.sparkSession
        own = f"{path.rstrip('/')}/{partition_col}={quote(value, safe=' !#$&()+,-.;<>@[]^_`{}|~')}"
        if path_exists(spark, own) and df.isEmpty():
            delete_path(spark, own)
    return path
