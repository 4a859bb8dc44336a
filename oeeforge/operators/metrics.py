"""Per product x machine metrics and the small aggregates built on them.

Everything is one grouping with conditional aggregates (``functions/groups.py``: a hot
couple is combined map-side before the shuffle, the rows of the others are shipped as they are). Inputs are history-shaped DataFrames
(``history.select(ANALYSIS_COLUMNS)``); Catalyst prunes the rest at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.config import AnalyticsConfig, AnomalyConfig
from oeeforge.functions.columns import blocked, exact_mean, non_null_array, not_blocked, safe_div
from oeeforge.functions.groups import aggregate
from oeeforge.operators.row_index import with_rank

MEAN_COLUMNS = {
    "cadence_theorique_moy": "cadence_theorique",
    "cadence_reelle_moy": "cadence_reelle",
    "ecart_moy": "ecart_pct",
    "trs_moy": "trs_pct",
    "performance_moy": "performance_pct",
    "disponibilite_moy": "disponibilite_pct",
    "qualite_moy": "qualite_pct",
}


def with_couple(df: DataFrame) -> DataFrame:
    """pandas ``groupby`` drops NULL keys: do the same before grouping."""
    return df.filter(F.col("produit").isNotNull() & F.col("machine").isNotNull())


def couple_metrics(history: DataFrame, cfg: AnalyticsConfig | None = None) -> DataFrame:
    """A1-A3: one row per (produit, machine) having at least one kept row.

    ``n_excluded_bloquant`` is counted before the exclusion (and even when the
    exclusion is off); couples whose rows are all excluded vanish.
    """
    cfg = cfg or AnalyticsConfig()
    keep = not_blocked() if cfg.exclude_bloquant else F.lit(True)

    def kept(c: str) -> Column:
        return F.when(keep, F.col(c))

    real = kept("cadence_reelle")
    agg = aggregate(with_couple(history), S.COUPLE, [
        F.count_if(keep).alias("n_of"),
        F.count_if(blocked()).alias("n_excluded_bloquant"),
        *[exact_mean(kept(src)).alias(name) for name, src in MEAN_COLUMNS.items()],
        F.min(real).alias("cadence_reelle_min"),
        F.max(real).alias("cadence_reelle_max"),
        F.count(real).alias("_n_real"),
        F.stddev_samp(real).alias("_std_real"),
    ])
    mean = F.col("cadence_reelle_moy")
    cv = F.when((F.col("_n_real") >= 2) & (mean != 0), safe_div(F.col("_std_real"), mean) * F.lit(100.0))
    return (
        agg.filter(F.col("n_of") > 0)
        .withColumn("stabilite_cv", cv)
        .select(
            *S.COUPLE, "n_of", "n_excluded_bloquant", "cadence_theorique_moy", "cadence_reelle_moy",
            "cadence_reelle_min", "cadence_reelle_max", "ecart_moy", "trs_moy", "performance_moy",
            "disponibilite_moy", "qualite_moy", "stabilite_cv",
        )
    )


def worst_first(metrics: DataFrame) -> DataFrame:
    """A4: OEE mean ascending, NULL last, ties by (produit, machine)."""
    return metrics.orderBy(F.col("trs_moy").asc_nulls_last(), "produit", "machine")


def ranked_metrics(metrics: DataFrame) -> DataFrame:
    """A4 as a column: rank 1 is the worst OEE mean, couples without one come last."""
    return with_rank(metrics, [F.col("trs_moy").isNull(), F.col("trs_moy"), F.col("produit"), F.col("machine")])


# Conclusion codes (A5), in emission order.
LIMITED_HISTORY = "LIMITED_HISTORY"
EXCLUDED_BLOCKING = "EXCLUDED_BLOCKING"
TRS_LOW = "TRS_LOW"
TRS_MODERATE = "TRS_MODERATE"
TRS_GOOD = "TRS_GOOD"
UNSTABLE = "UNSTABLE"
STABLE = "STABLE"
NOTHING_NOTABLE = "NOTHING_NOTABLE"


def with_conclusions(metrics: DataFrame, cfg: AnalyticsConfig | None = None) -> DataFrame:
    """A5: ``conclusion_codes`` (machine-readable) and ``conclusions`` (sentences)."""
    cfg = cfg or AnalyticsConfig()
    n, excl, trs, cv = F.col("n_of"), F.col("n_excluded_bloquant"), F.col("trs_moy"), F.col("stabilite_cv")
    trs_code = (
        F.when(trs.isNull(), F.lit(None))
        .when(trs < F.lit(float(cfg.trs_low_threshold)), F.lit(TRS_LOW))
        .when(trs < F.lit(float(cfg.trs_good_threshold)), F.lit(TRS_MODERATE))
        .otherwise(F.lit(TRS_GOOD))
    )
    cv_code = F.when(cv.isNull(), F.lit(None)).when(cv > F.lit(float(cfg.stability_cv_threshold)), F.lit(UNSTABLE)).otherwise(F.lit(STABLE))
    codes = non_null_array(
        F.when(n < F.lit(cfg.min_of_for_confidence), F.lit(LIMITED_HISTORY)),
        F.when(excl > 0, F.lit(EXCLUDED_BLOCKING)),
        trs_code,
        cv_code,
    )
    codes = F.when(F.size(codes) == 0, F.array(F.lit(NOTHING_NOTABLE))).otherwise(codes)
    out = metrics.withColumn("conclusion_codes", codes)
    sentence = lambda code: (  # noqa: E731 - presentation only
        F.when(code == LIMITED_HISTORY, F.format_string("Limited history (%d orders): conclusions to confirm with more data.", n))
        .when(code == EXCLUDED_BLOCKING, F.format_string("%d order(s) left out because of blocking quality findings.", excl))
        .when(code == TRS_LOW, F.format_string("Low mean OEE (%.1f%%): investigate this product x machine first.", trs))
        .when(code == TRS_MODERATE, F.format_string("Moderate mean OEE (%.1f%%): room for progress.", trs))
        .when(code == TRS_GOOD, F.format_string("Good mean OEE (%.1f%%).", trs))
        .when(code == UNSTABLE, F.format_string("Unstable rate (%.1f%% variation around the mean).", cv))
        .when(code == STABLE, F.format_string("Stable rate from one order to the next (%.1f%% variation).", cv))
        .otherwise(F.lit("Nothing notable on this couple."))
    )
    return out.withColumn("conclusions", F.transform("conclusion_codes", sentence))


def machine_stability(history: DataFrame, anomaly_cfg: AnomalyConfig | None = None) -> DataFrame:
    """Machines with >= min orders (non-blocked, actual rate known), CV ascending.

    Always excludes BLOQUANT rows, whatever the analytics switch says.
    """
    cfg = anomaly_cfg or AnomalyConfig()
    working = history.filter(not_blocked() & F.col("cadence_reelle").isNotNull() & F.col("machine").isNotNull())
    stats = working.groupBy("machine").agg(
        F.count(F.lit(1)).alias("n_of"),
        exact_mean("cadence_reelle").alias("_mean"),
        F.stddev_samp("cadence_reelle").alias("_std"),
    )
    cv = safe_div(F.col("_std"), F.col("_mean")) * F.lit(100.0)
    return (
        stats.filter((F.col("n_of") >= cfg.min_of_for_stat_detection) & (F.col("_mean") != 0) & F.col("_std").isNotNull())
        .select("machine", "n_of", cv.alias("coefficient_variation_pct"))
    )


def unevaluated_machines(history: DataFrame, stability: DataFrame) -> DataFrame:
    """Distinct machines of all rows minus ranked machines (one row, one pass)."""
    tagged = history.select("machine", F.lit(False).alias("_ranked")).unionByName(
        stability.select("machine", F.lit(True).alias("_ranked"))
    )
    return tagged.agg(
        F.count_distinct(F.when(~F.col("_ranked"), F.col("machine"))).alias("n_machines"),
        F.count_if(F.col("_ranked")).alias("n_ranked"),
    ).select("n_machines", "n_ranked", (F.col("n_machines") - F.col("n_ranked")).alias("n_machines_non_evaluees"))


def dimension_summary(history: DataFrame) -> DataFrame:
    """Row, product and machine counts (one row)."""
    return history.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("produit").alias("n_produits"),
        F.count_distinct("machine").alias("n_machines"),
    )
