import glob

from conftest import SF001
from helpers_exports import write_export_files
from oeeforge import cli


def _rows(spark, path, fmt="json"):
    return spark.read.format(fmt).option("header", "true").load(path).count()


def test_cli_phases_end_to_end(spark, tmpdir_path):
    ex = f"{tmpdir_path}/exports"
    write_export_files(spark, SF001, ex)
    hist, log, out = f"{tmpdir_path}/history", f"{tmpdir_path}/log", f"{tmpdir_path}/reports"
    assert cli.cmd_load(spark, _ns(exports=ex, history=hist, log=log, format="parquet", batch_id="b1")) == 0
    assert cli.cmd_quality(spark, _ns(exports=ex, out=f"{out}/quality", format="parquet")) == 1  # blocking rows exist
    assert _rows(spark, f"{out}/quality/counts") == 3 * len(glob.glob(f"{ex}/*.parquet"))
    assert cli.cmd_explore(spark, _ns(exports=ex, out=f"{out}/explore", format="parquet")) == 0
    assert _rows(spark, f"{out}/explore/formula_audit") == 3
    for name in ("analyze", "anomalies", "recommend", "diagnose"):
        assert getattr(cli, f"cmd_{name}")(spark, _ns(history=hist, out=f"{out}/{name}")) == 0
    n = _rows(spark, f"{out}/analyze/metrics")
    assert n > 0 and spark.read.json(f"{out}/analyze/summary").first().n_couples == n
    shown = spark.read.json(f"{out}/recommend").where("fiable").collect()
    assert shown and all(round(r.cadence_recommandee, 2) == r.cadence_recommandee and round(r.ecart_vs_theorique_pct, 1) == r.ecart_vs_theorique_pct
                         for r in shown if r.ecart_vs_theorique_pct is not None)
    ranked = sorted((r["rank"], r.fiable, r.produit, r.machine) for r in spark.read.json(f"{out}/recommend").collect())
    assert [r[0] for r in ranked] == list(range(1, len(ranked) + 1)) and ranked == sorted(ranked, key=lambda r: r[1:])
    assert _rows(spark, f"{out}/diagnose/cadence_theorique_a_corriger", "csv") > 0
    qs = f"{tmpdir_path}/questions"
    spark.createDataFrame([("1", "Quelles machines sont les plus stables ?"), ("2", "Pourquoi la Machine N°3 est lente ?")],
                          "question_id string, text string").write.parquet(qs)
    assert cli.cmd_ask(spark, _ns(history=hist, questions=qs, out=f"{out}/ask")) == 0
    assert _rows(spark, f"{out}/ask/answers") == 2


class _ns(dict):
    __getattr__ = dict.get


def test_train_writes_scores_importance_and_examples_with_intervals(spark, tmpdir_path, monkeypatch):
    import dataclasses

    from oeeforge.config import DEFAULT

    small = dataclasses.replace(DEFAULT, ml=dataclasses.replace(DEFAULT.ml, n_estimators=6, max_depth=4, cv_folds=3))
    monkeypatch.setattr(cli, "DEFAULT", small)
    ex, hist, log, out = (f"{tmpdir_path}/{n}" for n in ("exports", "history", "log", "out"))
    write_export_files(spark, SF001, ex)
    cli.cmd_load(spark, _ns(exports=ex, history=hist, log=log, format="parquet", batch_id="b1"))
    assert cli.cmd_train(spark, _ns(history=hist, model=f"{tmpdir_path}/model", out=out)) == 0
    cv = spark.read.json(f"{out}/cv").first()
    assert cv.n_folds == 3 and cv.cv_r2_mean > 0.4 and cv.cv_mae_std >= 0
    rows = spark.read.json(f"{out}/examples").collect()
    assert len({(r.code_of, r.machine) for r in rows}) == 3 and all(r.ci_low <= r.prediction <= r.ci_high for r in rows)
