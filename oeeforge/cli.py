"""Command line: the phases of the original pipeline as Spark jobs over folders and tables.

    python -m oeeforge.cli load      EXPORTS HISTORY LOG [--format parquet|csv|json|xlsx] [--batch-id ID]
    python -m oeeforge.cli explore   EXPORTS OUT [--format ...]        column profile + formula audit
    python -m oeeforge.cli quality   EXPORTS OUT [--format ...]        findings + counts; exit 1 if blocking
    python -m oeeforge.cli analyze   HISTORY OUT                       couple metrics + conclusions
    python -m oeeforge.cli anomalies HISTORY OUT                       outliers + short-history couples
    python -m oeeforge.cli recommend HISTORY OUT                       recommendations
    python -m oeeforge.cli diagnose  HISTORY OUT                       blocking diagnosis + to-fix CSV
    python -m oeeforge.cli train     HISTORY MODEL OUT                 CV, final fit, importance, examples
    python -m oeeforge.cli ask       HISTORY QUESTIONS OUT             answers for a (question_id, text) Parquet table

Every command reads with Spark and writes its report tables with ``sinks``;
nothing is collected to the driver except the blocking flag of ``quality``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge import sinks
from oeeforge.config import DEFAULT
from oeeforge.operators import diagnosis as D
from oeeforge.operators import metrics as A
from oeeforge.operators import ml as M
from oeeforge.operators import outliers as O
from oeeforge.operators import profile as P
from oeeforge.operators import quality as Q
from oeeforge.operators import questions as G
from oeeforge.operators import recommend as R
from oeeforge.plans import load_job
from oeeforge.session import get_spark, materialize
from oeeforge.functions.files import path_exists
from oeeforge.sources import exports as X
from oeeforge.sources import history as H


def staged_exports(spark: SparkSession, folder: str, fmt: str, probed: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Staged rows of an export folder, the Q1 structural findings (or None), and what is known of the files: their probe, or the problems of workbooks."""
    problems = None
    if fmt == "xlsx":
        parsed = materialize(X.read_workbooks(spark, folder), "workbooks")
        problems = parsed.filter(F.col("_status").isNotNull()).select("source_file", F.col("_status").alias("status"))
        staged, missing = X.normalise(X.workbook_frame(parsed))
        staged = staged.withColumn(S.EXTRACTED_AT, F.current_timestamp())
    else:
        probed = X.probe_files(spark, folder, fmt) if probed is None else probed
        staged, probed = X.load_exports(spark, fmt, probed)
        # each file's own header: Q1 per file
        return staged, Q.structural_findings(X.file_columns(spark, folder, fmt, probed)), probed
    if not missing:
        return staged, None, problems
    files = staged.select(F.col(S.SOURCE_FILE).alias("source_file")).distinct()
    return staged, Q.structural_findings(X.structural_columns(missing, files)), problems


def cmd_load(spark, a) -> int:
    probed = None if a.format == "xlsx" else X.probe_files(spark, a.exports, a.format)
    if not path_exists(spark, a.exports):
        X.file_status(spark, a.exports, fmt="parquet").show(truncate=False)
        return 1
    staged, structural, known = staged_exports(spark, a.exports, a.format, probed)
    if a.format == "xlsx":
        status = X.file_status(spark, a.exports, staged, a.format, known)
    else:
        status = X.file_status(spark, a.exports, fmt=a.format, probed=known)
    batch = a.batch_id or f"batch-{spark.sparkContext.applicationId}"
    audit = load_job.load(spark, staged, a.history, a.log, batch, DEFAULT, structural)
    audit.orderBy("source_file").show(truncate=False)
    bad = status.filter(~F.col("status").isin("OK")).count()
    return 1 if bad else 0


def cmd_explore(spark, a) -> int:
    staged = materialize(staged_exports(spark, a.exports, a.format)[0], "explore")
    sinks.write_json(P.column_profile(staged), f"{a.out}/profile")
    sinks.write_json(P.formula_audit(staged), f"{a.out}/formula_audit")
    sinks.write_json(P.formula_examples(staged), f"{a.out}/formula_examples")
    sinks.write_json(P.duplicate_rows(staged), f"{a.out}/duplicate_rows")
    sinks.write_json(P.missing_actual_rate(staged), f"{a.out}/missing_actual_rate")
    return 0


def cmd_quality(spark, a) -> int:
    staged, structural, _ = staged_exports(spark, a.exports, a.format)
    checked = materialize(Q.check_rows(staged, DEFAULT.quality), "checked")
    findings = Q.findings_table(checked)
    if structural is not None:
        findings = findings.unionByName(structural)
    files = checked.select(F.col(S.SOURCE_FILE).alias("source_file"))
    sinks.write_quality_report(findings, Q.severity_counts(findings, files), a.out)
    return 1 if Q.blocking_gate(findings).filter("has_blocking").limit(1).count() else 0


def _analysis(spark, path) -> DataFrame:
    return H.analysis_columns(H.read_history(spark, path))


def cmd_analyze(spark, a) -> int:
    m = A.with_conclusions(A.couple_metrics(_analysis(spark, a.history), DEFAULT.analytics), DEFAULT.analytics)
    sinks.write_metrics_report(A.ranked_metrics(m), a.out)
    return 0


def cmd_anomalies(spark, a) -> int:
    h = _analysis(spark, a.history)
    ex = DEFAULT.analytics.exclude_bloquant
    out = materialize(O.zscore_outliers(h, DEFAULT.anomalies, ex), "outliers")
    O.with_outlier_message(O.top_outliers(out)).select("message").show(truncate=False)
    sinks.write_outlier_report(O.ranked_outliers(O.with_outlier_message(out)), O.short_history(h, DEFAULT.anomalies, ex), a.out)
    return 0


def cmd_recommend(spark, a) -> int:
    h = _analysis(spark, a.history)
    ex = DEFAULT.analytics.exclude_bloquant
    recs = R.recommendations(h, O.zscore_outliers(h, DEFAULT.anomalies, ex), DEFAULT.recommendation, ex)
    sinks.write_recommendation_report(R.report_values(R.with_justification(recs, DEFAULT.recommendation)), a.out)
    return 0


def cmd_diagnose(spark, a) -> int:
    h = H.read_history(spark, a.history)
    sinks.write_json(D.blocking_by_rule(h), f"{a.out}/by_rule")
    sinks.write_json(D.blocking_by_column(h), f"{a.out}/by_column")
    sinks.write_to_fix_csv(D.to_fix_list(h), f"{a.out}/cadence_theorique_a_corriger")
    return 0


def cmd_train(spark, a) -> int:
    train = materialize(M.training_set(_analysis(spark, a.history), DEFAULT.analytics.exclude_bloquant), "train")
    try:
        M.check_min_rows(train, DEFAULT.ml)
    except M.NotEnoughData as exc:
        print(f"not trained: {exc}", file=sys.stderr)
        return 1
    cv = M.cv_summary(M.cross_validate(train, DEFAULT.ml))
    M.save_model(M.fit(train, DEFAULT.ml), a.model)
    model = M.load_model(a.model)
    tables = M.leaf_tables(spark, a.model, model)
    labels = M.labels_frame(spark, model, train)
    attr = M.attributions(model, train, tables)
    shown = M.predict_with_interval(model, train.orderBy("code_of", "machine").limit(3), tables).drop("prediction", "tree_mean")
    examples = M.top_contributions(M.attributions(model, shown, tables), labels)
    sinks.write_ml_report(cv, M.global_importance(attr, labels), examples, a.out)
    return 0


def cmd_ask(spark, a) -> int:
    h = _analysis(spark, a.history)
    qs = spark.read.parquet(a.questions).select(F.col("question_id").cast("string"), F.col("text").cast("string"))
    resolved = materialize(G.resolve_entities(G.classify_intent(qs), h, fuzzy=True), "resolved")
    ex = DEFAULT.analytics.exclude_bloquant
    metrics = materialize(A.with_conclusions(A.couple_metrics(h, DEFAULT.analytics), DEFAULT.analytics), "metrics")
    recs = materialize(R.with_justification(R.recommendations(
        h, O.zscore_outliers(h, DEFAULT.anomalies, ex), DEFAULT.recommendation, ex), DEFAULT.recommendation), "recs")
    stability = materialize(A.machine_stability(h, DEFAULT.anomalies), "stability")
    sinks.write_json(G.answer_questions(resolved, recs, metrics, stability, A.unevaluated_machines(h, stability)), f"{a.out}/answers")
    sinks.write_json(G.stability_answer(stability), f"{a.out}/machine_stability")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="oeeforge")
    sub = p.add_subparsers(dest="cmd", required=True)
    fmts = ["parquet", "csv", "json", "xlsx"]

    s = sub.add_parser("load"); s.add_argument("exports"); s.add_argument("history"); s.add_argument("log")  # noqa: E702
    s.add_argument("--format", default="parquet", choices=fmts); s.add_argument("--batch-id")  # noqa: E702
    for name in ("explore", "quality"):
        s = sub.add_parser(name); s.add_argument("exports"); s.add_argument("out")  # noqa: E702
        s.add_argument("--format", default="parquet", choices=fmts)
    for name in ("analyze", "anomalies", "recommend", "diagnose"):
        s = sub.add_parser(name); s.add_argument("history"); s.add_argument("out")  # noqa: E702
    s = sub.add_parser("train"); s.add_argument("history"); s.add_argument("model"); s.add_argument("out")  # noqa: E702
    s = sub.add_parser("ask"); s.add_argument("history"); s.add_argument("questions"); s.add_argument("out")  # noqa: E702

    a = p.parse_args(argv)
    spark = get_spark(app=f"oeeforge-{a.cmd}")
    return globals()[f"cmd_{a.cmd}"](spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
