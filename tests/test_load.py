from pyspark.sql import functions as F

from conftest import SF001
from helpers_exports import write_export_files
from oeeforge import schema as S
from oeeforge.plans import jobs, load_job
from oeeforge.sources import exports as X
from oeeforge.sources import history as H


def test_load_replay_and_retry(spark, tmpdir_path):
    folder = f"{tmpdir_path}/exports"
    write_export_files(spark, SF001, folder)
    staged, missing = X.read_exports(spark, folder, "parquet")
    assert missing == []
    hist, log = f"{tmpdir_path}/history", f"{tmpdir_path}/import_log"

    a1 = load_job.load(spark, staged, hist, log, "b1").collect()
    n_ins = sum(r.n_rows_inserted for r in a1)
    assert all(r.n_rows_inserted + r.n_rows_skipped_duplicate + r.n_rows_rejected_null_key == r.n_rows_extracted for r in a1)
    # same result as the in-memory history of the view
    assert n_ins == jobs.history_view(spark, SF001).count()
    # the file row index read from Parquet equals the view's index
    assert staged.select(F.regexp_replace(S.SOURCE_FILE, r"[.]parquet$", "").alias(S.SOURCE_FILE), S.ROW_INDEX, "code_of").exceptAll(
        jobs.checked_view(spark, SF001).select(S.SOURCE_FILE, S.ROW_INDEX, "code_of")).count() == 0

    # grand total row of the audit (rollup): source_file NULL, sums of the per-file rows
    from oeeforge.operators import load as L
    audit = spark.createDataFrame(a1).drop("imported_at", "batch_id")
    tot = L.audit_totals(audit).filter(F.col("source_file").isNull()).first()
    assert tot.n_rows_inserted == n_ins and tot.n_rows_extracted == sum(r.n_rows_extracted for r in a1)
    # replaying the same files under a new batch inserts nothing
    a2 = load_job.load(spark, staged, hist, log, "b2").collect()
    assert sum(r.n_rows_inserted for r in a2) == 0
    # retrying a batch rewrites its own partition with the same rows
    load_job.load(spark, staged, hist, log, "b1")
    h = H.read_history(spark, hist)
    assert h.count() == n_ins
    assert h.groupBy("code_of", "machine").count().filter(F.col("count") > 1).count() == 0


def test_csv_exports_and_file_status(spark, tmpdir_path):
    folder = f"{tmpdir_path}/csv"
    names = write_export_files(spark, SF001, folder, fmt="csv")[:3]
    with open(f"{folder}/notes.txt", "w") as fh:
        fh.write("not an export")
    staged, missing = X.read_exports(spark, folder, "csv")
    assert missing == []
    view = jobs.checked_view(spark, SF001).select(S.SOURCE_FILE, S.ROW_INDEX, "code_of", "trs_pct")
    got = staged.select(F.regexp_replace(S.SOURCE_FILE, r"\.csv$", "").alias(S.SOURCE_FILE), S.ROW_INDEX, "code_of", "trs_pct")
    assert got.exceptAll(view).count() == 0
    status = {r.source_file: r.status for r in X.file_status(spark, folder, staged, "csv").collect()}
    assert status["notes.txt"] == "UNSUPPORTED"
    assert status[f"{names[0]}.csv"] == "OK"
    assert X.file_status(spark, f"{tmpdir_path}/nope", None).first().status == "FILE_NOT_FOUND"


def test_missing_required_column_gives_structural_finding(spark, tmpdir_path):
    from oeeforge.operators import quality as Q

    folder = f"{tmpdir_path}/partial"
    import pandas as pd
    import os
    os.makedirs(folder)
    pd.DataFrame({"Code OF": ["a"], "Machine": ["m"], "TRS (%)": [50.0]}).to_csv(f"{folder}/x.csv", index=False)
    staged, missing = X.read_exports(spark, folder, "csv")
    assert "Produit" in missing and "Code OF" not in missing
    files = staged.select(F.col(S.SOURCE_FILE).alias("source_file")).distinct()
    f = Q.structural_findings(X.structural_columns(missing, files)).collect()
    assert len(f) == 1 and f[0].rule == "required_columns_missing" and f[0].row_index is None


def test_load_order_does_not_change_key_set(spark, tmpdir_path):
    import os
    import shutil

    src = f"{tmpdir_path}/all"
    names = write_export_files(spark, SF001, src)
    half = len(names) // 2
    first, second = f"{tmpdir_path}/first", f"{tmpdir_path}/second"
    for folder, part in ((first, names[:half]), (second, names[half:])):
        os.makedirs(folder)
        for n in part:
            shutil.copy(f"{src}/{n}.parquet", f"{folder}/{n}.parquet")

    def keys(order):
        hist, log = f"{tmpdir_path}/h-{order[0][-5:]}", f"{tmpdir_path}/l-{order[0][-5:]}"
        for i, folder in enumerate(order):
            staged, _ = X.read_exports(spark, folder, "parquet")
            load_job.load(spark, staged, hist, log, f"b{i}")
        return H.read_history(spark, hist).select("code_of", "machine")

    a, b = keys([first, second]), keys([second, first])
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_missing_column_is_reported_per_file(spark, tmpdir_path):
    import os

    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    from oeeforge.operators import quality as Q

    folder = f"{tmpdir_path}/mixed"
    os.makedirs(folder)
    full = {label: pd.Series([None], dtype="object" if t.simpleString() == "string" else "float64")
            for label, _, t in S.EXPORT_COLUMNS}
    full["Code OF"], full["Machine"] = pd.Series(["a"]), pd.Series(["m"])
    pq.write_table(pa.Table.from_pandas(pd.DataFrame(full)), f"{folder}/complete.parquet")
    partial = {k: v for k, v in full.items() if k != "TRS (%)"}
    pq.write_table(pa.Table.from_pandas(pd.DataFrame(partial)), f"{folder}/partial.parquet")
    f = Q.structural_findings(X.file_columns(spark, folder, "parquet")).collect()
    assert [(r.source_file, r.column) for r in f] == [("partial.parquet", "TRS (%)")]


def test_rows_of_a_null_key_are_kept_in_quarantine(spark, tmpdir_path):
    from conftest import rows_frame

    rows = [{"code_of": "a", "machine": "m"}, {"code_of": None, "machine": "m", "trs_pct": 40.0}, {"code_of": "b", "machine": None}, {"code_of": "c", "machine": "m"}]
    staged = rows_frame(spark, rows)
    hist, log = f"{tmpdir_path}/history", f"{tmpdir_path}/log"
    for batch in ("b1", "b1", "b2"):  # a retry rewrites its rows, another batch has its own
        audit = load_job.load(spark, staged, hist, log, batch).collect()
        assert [(r.n_rows_rejected_null_key, r.n_rows_extracted) for r in audit] == [(2, 4)]
    kept = spark.read.schema(S.HISTORY_SCHEMA).parquet(load_job.quarantine_path(hist)).collect()
    assert sorted((r.batch_id, r.row_index, r.trs_pct) for r in kept) == sorted((b, i, t) for b in ("b1", "b2") for i, t in ((1, 40.0), (2, None)))
    assert H.read_history(spark, hist).count() == 2


def test_first_per_key_ships_no_rows_and_keeps_one_row_of_a_place(spark):
    """The whole rows were sorted and shuffled by key for the few keys that repeat."""
    from oeeforge.operators import load as L

    rows = [("a", "m", "f2", 0, 1), ("a", "m", "f1", 9, 2), ("a", "m", "f1", 3, 3), ("b", "m", "f1", 1, 4), ("b", None, None, None, 5), ("b", None, "f1", 2, 6)]
    frame = lambda own: spark.createDataFrame(own, "code_of string, machine string, source_file string, row_index long, x int")
    got = L.first_per_key(frame(rows))
    assert sorted(r.x for r in got.collect()) == [3, 4, 5]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan
    # equal places: one row of the key is left
    assert L.first_per_key(frame(rows + [("a", "m", "f1", 3, 7)])).where("code_of = 'a'").count() == 1


def test_groups_are_aggregated_alike_below_and_above_a_tasks_rows(spark, monkeypatch):
    """Buffers of exact means were shipped for nearly every row of small groups."""
    from pyspark.sql import functions as F

    from oeeforge.functions import groups
    from oeeforge.functions.columns import exact_mean

    rows = spark.range(3000).selectExpr("if(id < 1500, 'hot', concat('k', id % 700)) a", "if(id % 50 = 0, null, 'm') b", "id / 7 x")
    aggs = [F.count(F.lit(1)).alias("n"), exact_mean("x").alias("m")]
    want = sorted(map(str, rows.groupBy("a", "b").agg(*aggs).collect()))
    assert sorted(map(str, groups.aggregate(rows, ["a", "b"], aggs).collect())) == want
    monkeypatch.setattr(groups, "ROWS_PER_TASK", 500)
    got = groups.aggregate(rows, ["a", "b"], aggs)
    assert sorted(map(str, got.collect())) == want
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_analysis_view_writes_only_its_columns(spark, monkeypatch):
    """The whole history, messages included, was written for every analysis."""
    from oeeforge import schema as S
    from oeeforge.plans import jobs

    written = []
    stage = jobs.materialize
    monkeypatch.setattr(jobs, "materialize", lambda df, name="stage": written.append(df.columns) or stage(df, name))
    assert jobs.analysis_view(spark, "/root/testdata/sf0.001").columns == list(S.ANALYSIS_COLUMNS)
    assert written == [list(S.ANALYSIS_COLUMNS)]
