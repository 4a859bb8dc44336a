"""The jobs that need no row index: same rows and severities as with one, nothing sorted, little shuffled."""

from pyspark.sql import functions as F

from conftest import SF001
from oeeforge import schema as S
from oeeforge.config import DEFAULT
from oeeforge.operators import quality as Q
from oeeforge.plans import jobs
from oeeforge.sources import production_view as V


def tables(spark, folder):
    """Lines whose keys repeat within and over files, with nulls in keys, dates and numbers."""
    line = spark.range(400).selectExpr(
        "if(id % 50 = 49, null, cast(id % 130 as long) * if(id % 130 % 3 = 0, 41, 7)) l_orderkey", "cast(id % 7 as long) l_partkey", "cast(id % 5 as long) l_suppkey", "cast(1 + id % 2 as int) l_linenumber",
        "if(id % 33 = 5, null, cast(id % 11 as double)) l_quantity", "cast(id % 90 as double) l_extendedprice", "(id % 11) / 100d l_discount", "(id % 9) / 100d l_tax",
        "if(id % 77 = 3, null, date_add(date'1995-01-01', cast(id * 3 % 120 as int))) l_shipdate")
    line.write.parquet(f"{folder}/lineitem.parquet")
    spark.range(7).selectExpr("id p_partkey", "concat('Brand#', id % 3) p_brand", "if(id = 6, null, concat('TYPE ', id)) p_type", "cast(id * 9 as int) p_size").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_analysis_rows_are_those_of_the_indexed_history(spark, tmp_path):
    for folder in (tables(spark, tmp_path), SF001):
        want = jobs.history_view(spark, folder).select(*S.ANALYSIS_COLUMNS)
        got = jobs.analysis_view(spark, folder)
        assert got.dtypes == want.dtypes and got.count() == want.count() > 100
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_severity_is_the_worst_finding(spark, tmp_path):
    checked = Q.check_rows(V.production_view(spark, tables(spark, tmp_path)), DEFAULT.quality)
    rank = F.array_max(F.transform("quality_details", lambda f: F.element_at(F.create_map(*[x for s, r in S.SEVERITY_RANK.items() for x in (F.lit(s), F.lit(r))]), f["severity"])))
    want = F.element_at(F.create_map(*[x for s, r in S.SEVERITY_RANK.items() for x in (F.lit(r), F.lit(s))]), rank)
    assert {r[0] for r in checked.select("quality_severity").distinct().collect()} >= {None, *S.SEVERITIES}
    assert checked.where(~F.col("quality_severity").eqNullSafe(want)).isEmpty()


def test_the_analysis_view_sorts_no_lines_and_writes_no_messages(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path)
    plans = []
    monkeypatch.setattr(jobs, "stage_table", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    indexed = []
    monkeypatch.setattr(V, "with_file_row_index", lambda *a, **k: indexed.append(a))
    jobs.analysis_view(spark, folder)
    assert not indexed and len(plans) == 1 and "format_string" not in plans[0] and "Sort " not in plans[0]
