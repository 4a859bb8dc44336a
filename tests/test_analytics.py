import math

from conftest import rows_frame
from oeeforge.operators import metrics as A
from oeeforge.operators import outliers as O
from oeeforge.operators import recommend as R


def _hist(spark, rows):
    h = rows_frame(spark, rows)
    from pyspark.sql import functions as F
    return h.withColumn("quality_severity", F.col("atelier"))  # severity passed through 'atelier' in fixtures


def test_stability_example(spark):
    rows = [{"code_of": "a", "machine": "M", "produit": "P", "cadence_reelle": 14.02, "trs_pct": 60.0},
            {"code_of": "b", "machine": "M", "produit": "P", "cadence_reelle": 21.65, "trs_pct": 60.0}]
    m = A.with_conclusions(A.couple_metrics(_hist(spark, rows))).collect()[0]
    assert math.isclose(m.cadence_reelle_moy, 17.835, rel_tol=0, abs_tol=1e-12)
    assert math.isclose(m.stabilite_cv, 30.25076950071969, rel_tol=1e-12)
    assert m.conclusion_codes == ["LIMITED_HISTORY", "TRS_MODERATE", "UNSTABLE"]


def test_null_severity_kept_and_blocked_excluded(spark):
    rows = [{"code_of": "a", "machine": "M", "produit": "P", "trs_pct": 80.0},
            {"code_of": "b", "machine": "M", "produit": "P", "trs_pct": 10.0, "atelier": "BLOQUANT"},
            {"code_of": "c", "machine": "M", "produit": "P", "trs_pct": 90.0, "atelier": "INFO"}]
    m = A.couple_metrics(_hist(spark, rows)).collect()[0]
    assert (m.n_of, m.n_excluded_bloquant, m.trs_moy) == (2, 1, 85.0)


def test_z_ceiling_five_vs_six(spark):
    six = [{"code_of": f"o{i}", "machine": "M", "produit": "P", "cadence_reelle": 10.0} for i in range(5)]
    six.append({"code_of": "far", "machine": "M", "produit": "P", "cadence_reelle": 40.0})
    out = O.zscore_outliers(_hist(spark, six)).collect()
    assert [(r.code_of, round(r.z_score, 2)) for r in out] == [("far", 2.04)]
    five = six[1:]
    assert O.zscore_outliers(_hist(spark, five)).count() == 0


def test_outlier_order_excluded_on_every_machine(spark):
    rows = [{"code_of": f"o{i}", "machine": "M1", "produit": "P", "cadence_reelle": 10.0, "trs_pct": 50.0}
            for i in range(5)]
    rows.append({"code_of": "X", "machine": "M1", "produit": "P", "cadence_reelle": 40.0, "trs_pct": 50.0})
    rows += [{"code_of": f"q{i}", "machine": "M2", "produit": "P", "cadence_reelle": 10.0 + i, "trs_pct": 50.0 + i}
             for i in range(3)]
    rows.append({"code_of": "X", "machine": "M2", "produit": "P", "cadence_reelle": 12.0, "trs_pct": 99.0})
    h = _hist(spark, rows)
    recs = {r.machine: r for r in R.recommendations(h, O.zscore_outliers(h)).collect()}
    assert recs["M2"].n_of_utilises == 3 and recs["M2"].n_of_disponibles == 4
    assert recs["M2"].trs_moyen_reference == 51.0  # the order X (trs 99) is excluded on M2 too
