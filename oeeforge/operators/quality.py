"""Quality rules (Q1-Q15) as one projection over the staged export rows.

A rule is a named Column that yields a finding struct or NULL for the row.
All row rules are evaluated in a single ``select``; the only shuffle is the
duplicate-key rule (Q3), done as a pre-aggregated ``groupBy(file, key).count``
joined back (map-side combine; AQE splits a hot key on the row side).

Input: staged rows (history column names) with ``_source_file`` and
``_row_index``. Output adds ``quality_details ARRAY<STRUCT>`` (findings in rule
order) and ``quality_severity`` (worst severity, NULL for a clean row).
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.config import QualityConfig
from oeeforge.functions.columns import non_null_array
from oeeforge.functions.joins import staged_side
from oeeforge.operators.repeats import FILE, repeated_places


def _num_str(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def finding(rule: str, severity: Column | str, message: Column, column: str | None) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(rule).alias("rule"),
        sev.alias("severity"),
        message.alias("message"),
        F.col(S.ROW_INDEX).cast("long").alias("row_index"),
        F.col("code_of").alias("code_of"),
        F.col("machine").alias("machine"),
        (F.lit(column) if column is not None else F.lit(None).cast("string")).alias("column"),
    )


@dataclass(frozen=True)
class Check:
    """When a row has a finding, how severe it is and what it says."""

    rule: str
    when: Column
    severity: Column | str
    message: Column
    column: str | None

    def found(self) -> Column:
        """The finding, or NULL."""
        return F.when(self.when, finding(self.rule, self.severity, self.message, self.column))

    def is_severity(self, severity: str) -> Column:
        if isinstance(self.severity, str):
            return self.when if self.severity == severity else F.lit(False)
        return self.when & (self.severity == F.lit(severity))


@dataclass(frozen=True)
class RowRule:
    """A named row rule: ``build(cfg)`` returns its checks."""

    name: str
    build: Callable[[QualityConfig], list[Check]]
    needs: tuple[str, ...]


# --- rule builders (each returns one check per checked column) --------------


def _missing_value(cfg: QualityConfig) -> list[Check]:
    real, qty = F.col("cadence_reelle"), F.col("qte_produite")
    expected = qty == 0
    sev = F.when(expected, F.lit(S.SEVERITY_INFO)).otherwise(F.lit(S.SEVERITY_AVERTISSEMENT))
    msg = F.when(
        expected, F.lit(f"Missing value in '{S.LABEL['cadence_reelle']}' (expected: nothing was produced)")
    ).otherwise(F.lit(f"Missing value in '{S.LABEL['cadence_reelle']}' (cause unknown, to check)"))
    return [Check(S.RULE_MISSING_VALUE, real.isNull(), sev, msg, S.LABEL["cadence_reelle"])]


def _duplicate_key(cfg: QualityConfig) -> list[Check]:
    msg = F.format_string("Duplicated key in file (code_of=%s, machine=%s)", F.col("code_of"), F.col("machine"))
    return [Check(S.RULE_DUPLICATE_KEY, F.col("_dup_key"), S.SEVERITY_BLOQUANT, msg, None)]


def _formula(rule: str, actual: str, computed: Column, tol: float, guard: Column | None = None) -> Check:
    diff = F.abs(computed - F.col(actual))
    cond = diff > F.lit(float(tol))
    if guard is not None:
        cond = guard & cond
    msg = F.format_string(
        "'%s' = %s differs from the computed value (%.2f), gap = %.2f",
        F.lit(S.LABEL[actual]), _num_str(F.col(actual)), computed, diff,
    )
    return Check(rule, cond, S.SEVERITY_AVERTISSEMENT, msg, S.LABEL[actual])


def _temps_net(cfg: QualityConfig) -> list[Check]:
    computed = F.col("duree_totale_min") - F.col("duree_arrets_min")
    return [_formula(S.RULE_TEMPS_NET, "temps_net_min", computed, cfg.tol_temps_net)]


def _ecart(cfg: QualityConfig) -> list[Check]:
    theo = F.col("cadence_theorique")
    computed = F.try_divide(F.col("cadence_reelle") - theo, theo) * F.lit(100.0)
    # theo = 0 is skipped; a NULL theo gives a NULL gap -> no finding.
    return [_formula(S.RULE_ECART, "ecart_pct", computed, cfg.tol_ecart, guard=~(theo == 0))]


def _trs(cfg: QualityConfig) -> list[Check]:
    computed = F.col("disponibilite_pct") * F.col("performance_pct") * F.col("qualite_pct") / F.lit(10000.0)
    return [_formula(S.RULE_TRS, "trs_pct", computed, cfg.tol_trs)]


def _pct_bounds(cfg: QualityConfig) -> list[Check]:
    out = []
    tol = float(cfg.percentage_tolerance)
    for c in S.STRICT_PERCENT:
        v = F.col(c)
        msg = F.format_string("'%s' = %s%% outside [0, 100]: impossible value", F.lit(S.LABEL[c]), _num_str(v))
        out.append(Check(S.RULE_PCT_BOUNDS, (v < F.lit(-tol)) | (v > F.lit(100.0 + tol)), S.SEVERITY_BLOQUANT, msg, S.LABEL[c]))
    return out


def _pct_ceiling(cfg: QualityConfig) -> list[Check]:
    out = []
    for c, warn, block in (
        ("performance_pct", cfg.performance_warning_max, cfg.performance_blocking_max),
        ("trs_pct", cfg.trs_warning_max, cfg.trs_blocking_max),
    ):
        v = F.col(c)
        is_block = v > F.lit(float(block))
        sev = F.when(is_block, F.lit(S.SEVERITY_BLOQUANT)).otherwise(F.lit(S.SEVERITY_AVERTISSEMENT))
        msg = F.when(
            is_block,
            F.format_string("'%s' = %s%%: far above the blocking level (%s%%), almost surely a data error",
                            F.lit(S.LABEL[c]), _num_str(v), F.lit(str(block))),
        ).otherwise(
            F.format_string("'%s' = %s%%: above %s%% but under the blocking level (%s%%), reference rate to recalibrate",
                            F.lit(S.LABEL[c]), _num_str(v), F.lit(str(warn)), F.lit(str(block)))
        )
        out.append(Check(S.RULE_PCT_CEILING, v > F.lit(float(warn)), sev, msg, S.LABEL[c]))
    return out


def _negative(cfg: QualityConfig) -> list[Check]:
    out = []
    for c in S.NON_NEGATIVE:
        v = F.col(c)
        msg = F.format_string("'%s' = %s: negative value is impossible", F.lit(S.LABEL[c]), _num_str(v))
        out.append(Check(S.RULE_NEGATIVE, v < 0, S.SEVERITY_BLOQUANT, msg, S.LABEL[c]))
    return out


def _low_theo(cfg: QualityConfig) -> list[Check]:
    v = F.col("cadence_theorique")
    t = float(cfg.min_plausible_cadence_theorique)
    msg = F.format_string("'%s' = %s pcs/min, suspiciously low (threshold %s): check the input",
                          F.lit(S.LABEL["cadence_theorique"]), _num_str(v), F.lit(str(t)))
    return [Check(S.RULE_LOW_THEO, (v > 0) & (v < F.lit(t)), S.SEVERITY_AVERTISSEMENT, msg, S.LABEL["cadence_theorique"])]


# Run order of the row rules (findings of a row come out in this order).
ROW_RULES: list[RowRule] = [
    RowRule(S.RULE_MISSING_VALUE, _missing_value, ("cadence_reelle",)),
    RowRule(S.RULE_DUPLICATE_KEY, _duplicate_key, ("code_of", "machine")),
    RowRule(S.RULE_TEMPS_NET, _temps_net, ("duree_totale_min", "duree_arrets_min", "temps_net_min")),
    RowRule(S.RULE_ECART, _ecart, ("cadence_reelle", "cadence_theorique", "ecart_pct")),
    RowRule(S.RULE_TRS, _trs, ("disponibilite_pct", "performance_pct", "qualite_pct", "trs_pct")),
    RowRule(S.RULE_PCT_BOUNDS, _pct_bounds, tuple(S.STRICT_PERCENT)),
    RowRule(S.RULE_PCT_CEILING, _pct_ceiling, tuple(S.FLEXIBLE_PERCENT)),
    RowRule(S.RULE_NEGATIVE, _negative, tuple(S.NON_NEGATIVE)),
    RowRule(S.RULE_LOW_THEO, _low_theo, ("cadence_theorique",)),
]
RULE_ORDER = [r.name for r in ROW_RULES]


def mark_duplicate_keys(staged: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Q3 scope: a (code_of, machine) repeated within one file.

    Counted among the rows whose key may occur more than once (``repeated``: ``repeats.repeated_places`` of
    these rows, where the caller has it), then joined back null-safely (pandas treats NaN
    keys as equal). A hot key is one row on the small side. The repeated keys
    are usually few: they are broadcast when a count shows they fit, otherwise
    the join shuffles (AQE splits a hot key).
    """
    keys = [S.SOURCE_FILE, *S.KEY_COLUMNS]
    repeated = repeated_places(staged) if repeated is None else repeated
    dups = (
        repeated.groupBy(F.col(FILE).alias(f"_dk_{S.SOURCE_FILE}"), *[F.col(k).alias(f"_dk_{k}") for k in S.KEY_COLUMNS])
        .agg(F.count(F.lit(1)).alias("_dk_n"))
        .filter(F.col("_dk_n") > 1)
        .withColumn("_dk_flag", F.lit(True))
        .drop("_dk_n")
    )
    dups = staged_side(dups, "duplicate-keys")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_dk_{k}"))
        cond = c if cond is None else cond & c
    joined = staged.join(dups, cond, "left")
    return joined.select(*[F.col(c) for c in staged.columns], F.coalesce(F.col("_dk_flag"), F.lit(False)).alias("_dup_key"))


def check_rows(staged: DataFrame, cfg: QualityConfig | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """Q2-Q11, Q14, Q15: attach findings and worst severity to every row (``repeated``: as for ``mark_duplicate_keys``)."""
    cfg = cfg or QualityConfig()
    present = set(staged.columns)
    marked = mark_duplicate_keys(staged, repeated) if set(S.KEY_COLUMNS) <= present else staged.withColumn("_dup_key", F.lit(False))
    items: list[Check] = []
    for rule in ROW_RULES:
        if set(rule.needs) <= present:  # each rule guards its own columns
            items.extend(rule.build(cfg))
    findings = non_null_array(*[x.found() for x in items]) if items else F.array().cast(S.FINDINGS)
    # from the conditions, so that jobs that read the severity alone write no messages; worst first
    severity = F.lit(None).cast("string")
    for name in sorted(S.SEVERITIES, key=S.SEVERITY_RANK.get):
        severity = F.when(reduce(operator.or_, [x.is_severity(name) for x in items], F.lit(False)), F.lit(name)).otherwise(severity)
    return marked.select(*[F.col(c) for c in staged.columns], findings.cast(S.FINDINGS).alias("quality_details"), severity.alias("quality_severity"))


def findings_table(checked: DataFrame) -> DataFrame:
    """Q11 long form: one row per finding (``inline`` of the per-row array)."""
    return checked.select(F.col(S.SOURCE_FILE).alias("source_file"), F.inline("quality_details"))


def structural_findings(file_columns: DataFrame) -> DataFrame:
    """Q1: one BLOQUANT finding per file lacking required columns.

    ``file_columns``: (source_file, columns ARRAY<STRING>) with the export labels
    present in each file. Output has the findings-table schema.
    """
    required = F.array(*[F.lit(label) for label, _, _ in S.EXPORT_COLUMNS])
    missing = F.array_except(required, F.col("columns"))
    return file_columns.filter(F.size(missing) > 0).select(
        F.col("source_file"),
        F.lit(S.RULE_REQUIRED_COLUMNS).alias("rule"),
        F.lit(S.SEVERITY_BLOQUANT).alias("severity"),
        F.concat(F.lit("Required column(s) absent from the export: "), F.array_join(missing, ", ")).alias("message"),
        F.lit(None).cast("long").alias("row_index"),
        F.lit(None).cast("string").alias("code_of"),
        F.lit(None).cast("string").alias("machine"),
        F.array_join(missing, ", ").alias("column"),
    )


def severity_counts(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Q12: findings per (source_file, severity); all three severities, zeros kept.

    One pass of conditional counts per file, then ``stack`` to long form (no
    cross join with a severity list). ``files`` (source_file) adds files that
    have no finding at all.
    """
    wide = findings.groupBy("source_file").agg(
        *[F.count_if(F.col("severity") == F.lit(s)).alias(f"n_{s}") for s in S.SEVERITIES]
    )
    if files is not None:
        wide = files.select("source_file").distinct().join(wide, "source_file", "left")
    stack = "stack(3, " + ", ".join(f"'{s}', coalesce(n_{s}, 0L)" for s in S.SEVERITIES) + ") as (severity, n_findings)"
    return wide.select("source_file", F.expr(stack))


def blocking_gate(findings: DataFrame) -> DataFrame:
    """Q13: per file, does any BLOQUANT finding exist (the caller exits 1 if so)."""
    return findings.groupBy("source_file").agg(
        F.bool_or(F.col("severity") == F.lit(S.SEVERITY_BLOQUANT)).alias("has_blocking")
    )
