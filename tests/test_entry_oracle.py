import duckdb

from conftest import SF001

NAMES = ["quality_counts", "couple_metrics", "zscore_outliers", "recommendations", "import_log",
         "blocking_by_rule", "entity_resolution_exact", "performance_lookup_exact"]


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "trs_moy" in df.columns


def test_queries_match_oracle_on_smallest_tables(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ["lineitem", "part", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    for name in NAMES:
        assert _rows(qs[name](spark, SF001).toPandas()) == _rows(con.execute(orc[name]).fetchdf()), name
