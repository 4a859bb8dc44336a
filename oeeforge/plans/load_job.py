"""Batch load of staged export rows into the history (L1-L5 with K7).

``load(staged, history_path, log_path, batch_id)``:

1. Q2-Q15 on the staged rows, materialized once (checkpoint): the history
   write and the audit both read it.
2. stored keys = the history without this batch's partition (so a retry of
   the same ``batch_id`` recomputes the same rows and overwrites them);
3. L1 + L3 + L2, then write the ``batch_id`` partition (dynamic overwrite);
   Rows of a NULL key go to the quarantine table beside the history instead, under the same ``batch_id``;
4. L5 audit from the staged rows and the *written* partition (no recompute),
   written to the import log under the same ``batch_id``.

Replaying files already loaded inserts nothing. One writer per history
table at a time (Parquet has no unique constraint); that is the documented
limit of the insert-only rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge import sinks
from oeeforge.config import AppConfig, DEFAULT
from oeeforge.operators import load as L
from oeeforge.operators import quality as Q
from oeeforge.plans.jobs import materialize
from oeeforge.sources import history as H


def quarantine_path(history_path: str) -> str:
    """The table of rejected rows beside a history."""
    return f"{history_path.rstrip('/')}_rejected"


def load(spark: SparkSession, staged: DataFrame, history_path: str, log_path: str, batch_id: str,
         cfg: AppConfig = DEFAULT, structural: DataFrame | None = None) -> DataFrame:
    checked = materialize(Q.check_rows(staged, cfg.quality))
    stored = H.stored_keys(H.read_history(spark, history_path), exclude_batch=batch_id) \
        if H.exists(spark, history_path) else None
    # staged: the write replaces files that the anti-join reads, and an empty result clears its partition
    candidates = L.to_history(checked, batch_id)
    rows = materialize(L.rows_to_insert(candidates, stored).select(*S.HISTORY_COLUMNS), "new-rows")
    sinks.write_partition(rows, history_path, value=batch_id)
    sinks.write_partition(L.rejected_rows(candidates).select(*S.HISTORY_COLUMNS), quarantine_path(history_path), value=batch_id)
    written = H.read_history(spark, history_path).filter(F.col("batch_id") == F.lit(batch_id))
    audit = L.import_audit(checked, written, structural).select(
        "source_file", F.current_timestamp().alias("imported_at"), "n_rows_extracted", "n_rows_inserted",
        "n_rows_skipped_duplicate", "n_rows_rejected_null_key", "n_bloquant", "n_avertissement", "n_info",
        F.lit(batch_id).alias("batch_id"),
    )
    sinks.write_partition(materialize(audit, "audit"), log_path, value=batch_id)
    return spark.read.schema(S.IMPORT_LOG_SCHEMA).parquet(log_path).filter(F.col("batch_id") == F.lit(batch_id))
