"""Blocking-row diagnosis over the history (A9-A11, K6 input).

The BLOQUANT predicate is a plain filter on ``quality_severity`` so it reaches
the Parquet scan of the history. Findings are expanded with ``explode`` of the
typed ``quality_details`` array (no JSON parsing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeeforge import schema as S


def blocked_rows(history: DataFrame) -> DataFrame:
    return history.filter(F.col("quality_severity") == F.lit(S.SEVERITY_BLOQUANT))


def _blocking_entries(history: DataFrame) -> DataFrame:
    """One entry per BLOQUANT finding of a BLOQUANT row, plus one marker per row.

    The marker (rule NULL) lets a single ``groupBy`` produce the row count used
    as the percentage denominator, so no scalar is collected or cross-joined.
    """
    rows = blocked_rows(history)
    blocking = F.filter(F.col("quality_details"), lambda f: f["severity"] == F.lit(S.SEVERITY_BLOQUANT))
    marker = F.array(F.struct(
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("message"),
    ))
    entries = F.concat(marker, F.transform(
        F.coalesce(blocking, F.array().cast(S.FINDINGS)),
        lambda f: F.struct(f["rule"].alias("rule"), f["column"].alias("column"), f["message"].alias("message")),
    ))
    return rows.select(
        F.struct(F.col("source_file"), F.col("row_index")).alias("_o"),
        "code_of", "machine", "produit", F.explode(entries).alias("e"),
    )


def blocking_by_rule(history: DataFrame) -> DataFrame:
    """Occurrences per rule, share of BLOQUANT *rows* (may exceed 100), first example."""
    e = _blocking_entries(history)
    g = e.groupBy(F.col("e.rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by(F.struct("code_of", "machine", "produit", F.col("e.message").alias("message")), F.col("_o")).alias("_ex"),
    )
    # the grouped result has one row per rule (+ the marker row): a tiny window
    n_rows = F.max(F.when(F.col("rule").isNull(), F.col("occurrences"))).over(Window.partitionBy())
    return (
        g.withColumn("n_blocked_rows", n_rows)
        .filter(F.col("rule").isNotNull())
        .select(
            "rule", "occurrences", "n_blocked_rows",
            (F.col("occurrences") * F.lit(100.0) / F.col("n_blocked_rows")).alias("pct_rows"),
            F.col("_ex.code_of").alias("example_code_of"), F.col("_ex.machine").alias("example_machine"),
            F.col("_ex.produit").alias("example_produit"), F.col("_ex.message").alias("example_message"),
        )
    )


def blocking_by_column(history: DataFrame) -> DataFrame:
    """A10: occurrences per non-empty column among BLOQUANT findings."""
    e = _blocking_entries(history).filter(F.col("e.rule").isNotNull())
    return (
        e.filter(F.col("e.column").isNotNull() & (F.col("e.column") != ""))
        .groupBy(F.col("e.column").alias("column"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def to_fix_list(history: DataFrame) -> DataFrame:
    """BLOQUANT rows with a BLOQUANT ceiling finding: the reference rate is probably wrong."""
    ceiling = F.exists(
        F.col("quality_details"),
        lambda f: (f["rule"] == F.lit(S.RULE_PCT_CEILING)) & (f["severity"] == F.lit(S.SEVERITY_BLOQUANT)),
    )
    return blocked_rows(history).filter(ceiling).select(
        "code_of", "produit", "machine",
        F.col("cadence_theorique").alias("cadence_theorique_saisie"),
        F.col("cadence_reelle").alias("cadence_reelle_observee"),
    )
