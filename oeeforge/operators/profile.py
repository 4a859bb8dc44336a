"""Exploration of staged exports.

* P1 ``column_profile``: per column dtype, missing count/share, distinct
  non-NULL count and the first five distinct values in first-seen order.
  Columns are unpivoted to (column, value) once; distinct values are found
  with a partial-aggregated ``groupBy`` and the five samples with a
  ``row_number() <= 5`` top-k (partial WindowGroupLimit before the shuffle).
* P2 candidate dimensions: 0 < n_unique <= threshold.
* P3 ``formula_audit``: per formula, bad rows / rows / share, one pass of
  conditional counts; ``formula_examples`` keeps the first five bad rows.
* P4 ``duplicate_rows``: extra copies of a key per file (keep-first count).
* P5 ``missing_actual_rate``: rows whose actual rate is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.config import ProfileConfig, QualityConfig
from oeeforge.functions.joins import staged_side
from oeeforge.operators.row_index import with_rank


def _order() -> Column:
    return F.struct(F.col(S.SOURCE_FILE), F.col(S.ROW_INDEX))


def _with_order_key(staged: DataFrame) -> DataFrame:
    """``_o`` = file rank * 2^40 + row index: the (file, row) order as one BIGINT (8 million files of a million million rows).

    A fixed-width key lets the first-seen ``min`` run as a hash aggregate
    (a struct with a string needs a sort aggregate). The file ranks come from
    the distinct file names: one row per file, broadcast after a size check.
    """
    files = staged.select(F.col(S.SOURCE_FILE).alias("_f")).distinct()
    ranks = with_rank(files, [F.col("_f")], "_fr")
    ranks = staged_side(ranks, "file-ranks")
    keyed = staged.join(ranks, F.col(S.SOURCE_FILE).eqNullSafe(F.col("_f")), "left")
    return keyed.withColumn("_o", F.shiftleft(F.coalesce("_fr", F.lit(0).cast("long")), 40) + F.col(S.ROW_INDEX).cast("long"))


def column_profile(staged: DataFrame, columns: list[str] | None = None, cfg: ProfileConfig | None = None) -> DataFrame:
    cfg = cfg or ProfileConfig()
    columns = columns or [c for c in staged.columns if c != S.ROW_INDEX]
    dtypes = dict((f.name, f.dataType.simpleString()) for f in staged.schema.fields)
    meta = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"))
        for i, c in enumerate(columns)
    ])
    # unpivot: (order, pos, value as text); NULLs kept for the missing count
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)
    ])
    long = _with_order_key(staged).select("_o", F.inline(cells))
    totals = long.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("value").isNull()).alias("n_missing")
    )
    values = long.filter(F.col("value").isNotNull()).groupBy("pos", "value").agg(F.min("_o").alias("_first"))
    uniq = values.groupBy("pos").agg(F.count(F.lit(1)).alias("n_unique"))
    w = Window.partitionBy("pos").orderBy("_first")
    samples = (
        values.withColumn("_rk", F.row_number().over(w))
        .filter(F.col("_rk") <= cfg.n_samples)
        .groupBy("pos")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "value"))), lambda s: s["value"]), ", ")
             .alias("sample_values"))
    )
    out = (
        totals.join(uniq, "pos", "left")
        .join(samples, "pos", "left")
        .select(
            "pos", F.element_at(meta, F.col("pos") + 1)["column"].alias("column"),
            F.element_at(meta, F.col("pos") + 1)["dtype"].alias("dtype"),
            "n_missing", F.coalesce(F.col("n_unique"), F.lit(0).cast("long")).alias("n_unique"), "n_total",
            "sample_values",
        )
    )
    return _finish(out, cfg)


def _finish(out: DataFrame, cfg: ProfileConfig) -> DataFrame:
    pct = F.when(F.col("n_total") > 0, F.col("n_missing") * F.lit(100.0) / F.col("n_total")).otherwise(F.lit(0.0))
    cand = (F.col("n_unique") > 0) & (F.col("n_unique") <= cfg.low_cardinality_threshold)
    return out.select(
        "pos", "column", "dtype", "n_missing", pct.alias("pct_missing"), "n_unique", "sample_values",
        cand.alias("is_candidate_dimension"),
    )


def candidate_dimensions(profile: DataFrame) -> DataFrame:
    """P2."""
    return profile.filter("is_candidate_dimension").select("column", "n_unique")


def _formulas(cfg: QualityConfig) -> list[tuple[str, Column, Column, float, Column]]:
    """(name, computed, actual, tolerance, row-in-denominator)."""
    theo = F.col("cadence_theorique")
    return [
        ("temps_net", F.col("duree_totale_min") - F.col("duree_arrets_min"), F.col("temps_net_min"),
         cfg.tol_temps_net, F.lit(True)),
        # pandas keeps NaN != 0 rows in the denominator
        ("ecart", (F.col("cadence_reelle") - theo) / theo * F.lit(100.0), F.col("ecart_pct"), cfg.tol_ecart,
         ~theo.eqNullSafe(F.lit(0.0))),
        ("trs", F.col("disponibilite_pct") * F.col("performance_pct") * F.col("qualite_pct") / F.lit(10000.0),
         F.col("trs_pct"), cfg.tol_trs, F.lit(True)),
    ]


def formula_audit(staged: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """One pass; output (formula, tolerance, n_bad, n_total, pct_bad)."""
    cfg = cfg or QualityConfig()
    aggs, items = [], []
    for i, (name, computed, actual, tol, inc) in enumerate(_formulas(cfg)):
        bad = inc & (F.abs(F.when(inc, computed) - actual) > F.lit(float(tol)))
        aggs += [F.count_if(bad).alias(f"_b{i}"), F.count_if(inc).alias(f"_t{i}")]
        items.append(F.struct(F.lit(name).alias("formula"), F.lit(float(tol)).alias("tolerance"),
                              F.col(f"_b{i}").alias("n_bad"), F.col(f"_t{i}").alias("n_total")))
    out = staged.agg(*aggs).select(F.inline(F.array(*items)))
    return out.withColumn(
        "pct_bad", F.when(F.col("n_total") > 0, F.col("n_bad") * F.lit(100.0) / F.col("n_total"))
    )


def formula_examples(staged: DataFrame, cfg: QualityConfig | None = None, n: int = 5) -> DataFrame:
    """P3 examples: the first ``n`` bad rows of each formula (the limit is the feature)."""
    cfg = cfg or QualityConfig()
    tags = F.array(*[
        F.when(inc & (F.abs(F.when(inc, computed) - actual) > F.lit(float(tol))), F.lit(name))
        for name, computed, actual, tol, inc in _formulas(cfg)
    ])
    bad = staged.select("*", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("formula"))
    w = Window.partitionBy("formula").orderBy(S.SOURCE_FILE, S.ROW_INDEX)
    return bad.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def duplicate_rows(staged: DataFrame) -> DataFrame:
    """Per file, rows that repeat an earlier (code_of, machine) (keep-first count)."""
    per_key = staged.groupBy(S.SOURCE_FILE, *S.KEY_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(F.col(S.SOURCE_FILE).alias("source_file")).agg(
        F.sum(F.col("_n") - 1).alias("n_duplicate_rows"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated_keys"),
    )


def missing_actual_rate(staged: DataFrame) -> DataFrame:
    """P5: rows with a NULL actual rate."""
    return staged.filter(F.col("cadence_reelle").isNull()).select(
        F.col(S.SOURCE_FILE).alias("source_file"), F.col(S.ROW_INDEX).alias("row_index"),
        "code_of", "machine", "produit", "qte_produite",
    )
