from pyspark.sql import functions as F

from conftest import SF01, rows_frame
from oeeforge.operators import quality as Q
from oeeforge.plans import jobs


def _findings(spark, rows):
    return {(f.row_index, f.rule, f.severity, f.column)
            for f in Q.findings_table(Q.check_rows(rows_frame(spark, rows))).collect()}


def test_ceiling_thresholds(spark):
    # performance 100 / 100.01 / 120 / 120.01 -> none, W, W, B
    rows = [{"code_of": f"o{i}", "machine": "m", "performance_pct": v} for i, v in enumerate([100.0, 100.01, 120.0, 120.01])]
    got = {(r, s) for r, rule, s, _ in _findings(spark, rows) if rule == "percentage_ceiling_exceeded"}
    assert got == {(1, "AVERTISSEMENT"), (2, "AVERTISSEMENT"), (3, "BLOQUANT")}


def test_strict_percent_and_low_theo(spark):
    rows = [{"code_of": f"o{i}", "machine": "m", "disponibilite_pct": v} for i, v in enumerate([-1.0, -1.01, 101.0, 101.01])]
    got = {r for r, rule, s, _ in _findings(spark, rows) if rule == "percentage_out_of_bounds"}
    assert got == {1, 3}
    rows = [{"code_of": f"o{i}", "machine": "m", "cadence_theorique": v} for i, v in enumerate([0.0, 0.49, 0.5])]
    got = {r for r, rule, s, _ in _findings(spark, rows) if rule == "suspicious_low_cadence_theorique"}
    assert got == {1}


def test_gap_fault_and_theo_zero(spark):
    rows = [
        {"code_of": "a", "machine": "m", "cadence_reelle": 0.62, "cadence_theorique": 0.03, "ecart_pct": 1770.91},
        {"code_of": "b", "machine": "m", "cadence_reelle": 5.0, "cadence_theorique": 0.0, "ecart_pct": 12.0},
    ]
    got = _findings(spark, rows)
    assert (0, "ecart_formula", "AVERTISSEMENT", "Écart (%)") in got
    assert not any(r == 1 and rule == "ecart_formula" for r, rule, _, _ in got)


def test_missing_value_info_vs_warning_and_duplicates(spark):
    rows = [
        {"code_of": "a", "machine": "m", "qte_produite": 0},
        {"code_of": "b", "machine": "m", "qte_produite": 5},
        {"code_of": "c", "machine": "m", "cadence_reelle": 1.0},
        {"code_of": "c", "machine": "m", "cadence_reelle": 1.0},
        {"code_of": "c", "machine": "m", "cadence_reelle": 1.0, "_source_file": "f2"},
    ]
    got = _findings(spark, rows)
    assert (0, "missing_value", "INFO", "Cadence Réelle (pcs/min)") in got
    assert (1, "missing_value", "AVERTISSEMENT", "Cadence Réelle (pcs/min)") in got
    dup = {r for r, rule, _, _ in got if rule == "duplicate_key"}
    assert dup == {2, 3}  # the copy in another file is not a duplicate


def test_clean_row_has_null_severity_and_worst_wins(spark):
    rows = [
        {"code_of": "a", "machine": "m", "cadence_reelle": 10.0, "qte_produite": 3},
        {"code_of": "b", "machine": "m", "qte_produite": 0, "trs_pct": 130.0},
    ]
    sev = {r.code_of: r.quality_severity for r in Q.check_rows(rows_frame(spark, rows)).collect()}
    assert sev == {"a": None, "b": "BLOQUANT"}


def test_view_counts_match_fixture_table(spark):
    checked = jobs.checked_view(spark, SF01)
    f = Q.findings_table(checked)
    c = {(r.rule, r.severity): r.n for r in f.groupBy("rule", "severity").agg(F.count("*").alias("n")).collect()}
    assert checked.count() == 60000
    assert c[("missing_value", "INFO")] == 1479 and c[("missing_value", "AVERTISSEMENT")] == 620
    assert c[("ecart_formula", "AVERTISSEMENT")] == 848
    assert c[("temps_net_formula", "AVERTISSEMENT")] == 1179
    assert c[("suspicious_low_cadence_theorique", "AVERTISSEMENT")] == 583
    assert c[("duplicate_key", "BLOQUANT")] == 4
    perf = f.filter((F.col("rule") == "percentage_ceiling_exceeded") & (F.col("column") == "Performance (%)"))
    assert perf.filter(F.col("severity") == "BLOQUANT").count() == 568
    assert perf.filter(F.col("severity") == "AVERTISSEMENT").count() == 8417
