"""History load (L1-L5): project, dedupe, anti-join, append, audit.

* L1 ``to_history``: rename/cast to the history schema; BLOQUANT rows are kept
  with their flag.
* L3 ``first_per_key``: the first row of a key by (file name, row index) wins.
  Only the places of rows whose key's hash occurs more than once are shuffled and
  reduced (map-side first, so a key holding a third of the rows is no task's alone);
  the rows stay where they are and are held against their key's first place.
* L2 ``new_rows``: ``left_anti`` join against the stored keys. Both sides are
  unique on the key, so there is no skew; AQE broadcasts the smaller side when
  its measured size allows.
* L5 ``import_audit``: per file extracted / inserted / skipped / rejected rows
  and findings per severity.

Rows with a NULL key are rejected (quarantined) rather than stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.functions.joins import staged_side
from oeeforge.operators.repeats import AT, FILE, repeated_places


def null_key(df: DataFrame) -> Column:
    return F.col("code_of").isNull() | F.col("machine").isNull()


def to_history(checked: DataFrame, batch_id: str | Column, loaded_at: Column | None = None) -> DataFrame:
    """L1: checked staged rows -> history schema (plus ``row_index`` kept for order)."""
    loaded = loaded_at if loaded_at is not None else F.current_timestamp()
    extracted = F.col(S.EXTRACTED_AT).cast("timestamp") if S.EXTRACTED_AT in checked.columns else F.lit(None).cast("timestamp")
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    return checked.select(
        *[F.col(c).cast(S.TYPE[c]).alias(c) for c in S.DATA_COLUMNS],
        F.col("quality_severity"),
        F.col("quality_details").cast(S.FINDINGS).alias("quality_details"),
        F.col(S.SOURCE_FILE).alias("source_file"),
        F.col(S.ROW_INDEX).cast("long").alias("row_index"),
        extracted.alias("extracted_at"),
        loaded.alias("loaded_at"),
        bid.alias("batch_id"),
        *[c for c in (S.PLACE,) if c in checked.columns],
    )


def first_per_key(rows: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """L3: one row per (code_of, machine): the first by (source_file, row_index), or by the place where the rows have one.

    ``repeated``: ``repeats.repeated_places`` of these rows (rows of other keys may be in it), where the caller has it.
    """
    cols = rows.columns
    row = S.PLACE if S.PLACE in cols else "row_index"
    order = F.struct(F.col("source_file"), (F.col(row) if row == S.PLACE else F.col(row).cast("long")).alias(AT))
    # where the first row of a repeated key stands: from the key and the place alone, no other column is read or shuffled
    repeated = repeated_places(rows) if repeated is None else repeated
    places = repeated.groupBy(*S.KEY_COLUMNS, FILE, AT).agg(F.count(F.lit(1)).alias("_n"))
    place = F.struct(F.col(FILE), F.col(AT))
    firsts = places.groupBy(*[F.col(c).alias(f"_f_{c}") for c in S.KEY_COLUMNS]).agg(F.min(place).alias("_first"), F.min_by("_n", place).alias("_ties"))
    firsts = staged_side(firsts, "first-places")
    if not firsts.where("_ties > 1").isEmpty():  # several rows of a key at one place: any one of them
        picked = rows.groupBy(*S.KEY_COLUMNS).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
        return picked.select(*[F.col(f"_r.{c}").alias(c) for c in cols])
    same_key = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in S.KEY_COLUMNS]
    placed = rows.join(firsts, same_key[0] & same_key[1], "left")
    return placed.where(F.col("_first").isNull() | order.eqNullSafe(F.col("_first"))).select(*cols)


def new_rows(candidates: DataFrame, stored_keys: DataFrame | None) -> DataFrame:
    """L2: drop candidates whose key is already stored (stored rows are never updated)."""
    if stored_keys is None:
        return candidates
    keys = stored_keys.select(*S.KEY_COLUMNS)
    return candidates.join(keys, on=S.KEY_COLUMNS, how="left_anti")


def rows_to_insert(history_rows: DataFrame, stored_keys: DataFrame | None, repeated: DataFrame | None = None) -> DataFrame:
    """L1 output -> the rows this load appends (NULL keys rejected, L3 then L2; ``repeated``: as for ``first_per_key``)."""
    valid = history_rows.filter(~null_key(history_rows))
    if repeated is not None:
        repeated = repeated.filter(~null_key(repeated))
    return new_rows(first_per_key(valid, repeated), stored_keys)


def rejected_rows(history_rows: DataFrame) -> DataFrame:
    """The rows of a NULL key, which are kept apart (quarantine) instead of stored."""
    return history_rows.filter(null_key(history_rows))


def import_audit(checked: DataFrame, inserted: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Per source file, row counts and findings per severity (findings, not rows).

    ``checked``: staged rows with ``quality_details``; ``inserted``: the rows the
    load appends (with ``source_file``); ``structural``: optional file-level
    findings (Q1) with ``source_file`` and ``severity``.
    """
    sev = lambda s: F.aggregate(
        F.col("quality_details"), F.lit(0).cast("long"),
        lambda acc, f: acc + F.when(f["severity"] == F.lit(s), F.lit(1)).otherwise(F.lit(0)).cast("long"),
    )
    per_file = checked.groupBy(F.col(S.SOURCE_FILE).alias("source_file")).agg(
        F.count(F.lit(1)).alias("n_rows_extracted"),
        F.count_if(null_key(checked)).alias("n_rows_rejected_null_key"),
        F.sum(sev(S.SEVERITY_BLOQUANT)).alias("n_bloquant"),
        F.sum(sev(S.SEVERITY_AVERTISSEMENT)).alias("n_avertissement"),
        F.sum(sev(S.SEVERITY_INFO)).alias("n_info"),
    )
    if structural is not None:
        extra = structural.groupBy("source_file").agg(
            *[F.count_if(F.col("severity") == F.lit(s)).alias(f"_x_{s}") for s in S.SEVERITIES]
        )
        per_file = per_file.join(extra, "source_file", "left").select(
            "source_file", "n_rows_extracted", "n_rows_rejected_null_key",
            (F.col("n_bloquant") + F.coalesce(F.col(f"_x_{S.SEVERITY_BLOQUANT}"), F.lit(0))).alias("n_bloquant"),
            (F.col("n_avertissement") + F.coalesce(F.col(f"_x_{S.SEVERITY_AVERTISSEMENT}"), F.lit(0))).alias("n_avertissement"),
            (F.col("n_info") + F.coalesce(F.col(f"_x_{S.SEVERITY_INFO}"), F.lit(0))).alias("n_info"),
        )
    ins = inserted.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows_inserted"))
    out = per_file.join(ins, "source_file", "left").withColumn(
        "n_rows_inserted", F.coalesce(F.col("n_rows_inserted"), F.lit(0).cast("long"))
    )
    return out.select(
        "source_file",
        "n_rows_extracted",
        "n_rows_inserted",
        (F.col("n_rows_extracted") - F.col("n_rows_inserted") - F.col("n_rows_rejected_null_key")).alias(
            "n_rows_skipped_duplicate"
        ),
        "n_rows_rejected_null_key",
        F.coalesce(F.col("n_bloquant"), F.lit(0).cast("long")).alias("n_bloquant"),
        F.coalesce(F.col("n_avertissement"), F.lit(0).cast("long")).alias("n_avertissement"),
        F.coalesce(F.col("n_info"), F.lit(0).cast("long")).alias("n_info"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    """L5 grand total as a ``rollup`` row (source_file NULL) next to the per-file rows."""
    num = [c for c in audit.columns if c != "source_file"]
    return audit.rollup("source_file").agg(*[F.sum(c).alias(c) for c in num])
