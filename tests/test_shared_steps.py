"""The steps that all analyses share: keys counted once, few columns written, groups not counted one by one."""

import pytest
from pyspark.sql import functions as F

from oeeforge import schema as S
from oeeforge.config import DEFAULT
from oeeforge.functions import groups, joins
from oeeforge.operators import load as L
from oeeforge.operators import metrics as A
from oeeforge.operators import quality as Q
from oeeforge.operators import repeats
from oeeforge.plans import jobs, queries
from oeeforge.sources import production_view as V
from test_placed_rows import tables


@pytest.fixture()
def staged(monkeypatch):
    """The names and columns of the small sides that are staged."""
    seen = []
    for module in (repeats, Q, L, groups):
        real = module.staged_side
        monkeypatch.setattr(module, "staged_side", lambda df, name, real=real: seen.append((name, df.columns)) or real(df, name))
    return seen


def test_an_analysis_counts_keys_once_and_writes_what_it_reads(spark, tmp_path, staged, monkeypatch):
    folder = tables(spark, tmp_path)
    written = []
    stage = jobs.stage_table
    monkeypatch.setattr(jobs, "stage_table", lambda df, name: written.append(df.columns) or stage(df, name))
    got = queries.registry()["dimension_summary"](spark, folder).collect()
    assert written == [["produit", "machine"]]
    # the keys' hashes were counted for the duplicates of a file and again for the first rows
    assert [n for n, _ in staged] == ["repeated-keys", "repeated-places", "duplicate-keys", "first-places"]
    assert got == A.dimension_summary(jobs.history_view(spark, folder)).collect()


@pytest.mark.parametrize("name,of", [("couple_metrics", queries.METRICS_READ), ("recommendations", queries.RECOMMENDATIONS_READ), ("short_history", queries.OUTLIERS_READ),
                                     ("stability_summary", queries.STABILITY_READ), ("product_index", ["produit"])])
def test_the_columns_left_out_change_no_result(spark, tmp_path, monkeypatch, name, of):
    folder = tables(spark, tmp_path)
    query, view, asked = queries.registry()[name], jobs.analysis_view, []
    got = sorted(map(str, query(spark, folder).collect()))
    monkeypatch.setattr(jobs, "analysis_view", lambda spark, d, columns=(): asked.append(list(columns)) or view(spark, d))
    assert sorted(map(str, query(spark, folder).collect())) == got and got and asked == [list(of)]


def test_given_places_give_the_same_duplicates_and_first_rows(spark, tmp_path):
    rows = V.placed_view(spark, tables(spark, tmp_path))
    repeated = repeats.repeated_places(rows)
    mark = lambda df: sorted(map(str, df.select(*S.KEY_COLUMNS, S.SOURCE_FILE, "quality_severity").collect()))
    own, given = Q.check_rows(rows, DEFAULT.quality), Q.check_rows(rows, DEFAULT.quality, repeated)
    assert mark(own) == mark(given)
    counts = {(r[0], r[1], r[2]): r["n"] for r in rows.groupBy(S.SOURCE_FILE, *S.KEY_COLUMNS).agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in Q.mark_duplicate_keys(rows, repeated).select(S.SOURCE_FILE, *S.KEY_COLUMNS, "_dup_key").collect():
        assert r["_dup_key"] == (counts[r[0], r[1], r[2]] > 1)
    first = lambda df, places: sorted(map(str, L.rows_to_insert(L.to_history(df, "b", F.lit(None).cast("timestamp")), None, places).collect()))
    assert first(given, repeated) == first(own, None)
    keys = {(r[0], r[1]) for r in rows.select(*S.KEY_COLUMNS).collect() if None not in (r[0], r[1])}
    assert len(first(given, repeated)) == len(keys)


def test_lines_are_not_sorted_for_their_part(spark, tmp_path):
    plan = V.raw_lines(spark, tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMergeJoin", "Sort ")


def test_ordinary_groups_are_counted_by_bucket(spark, monkeypatch, staged):
    rows = spark.range(40_000).selectExpr("concat('k', id) a", "'m' b", "id x")
    monkeypatch.setattr(groups, "ROWS_PER_TASK", 4_000)
    got = groups.aggregate(rows, ["a", "b"], [F.sum("x").alias("x")])
    assert staged == [("large-buckets", ["_bucket"])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "RepartitionByExpression" in plan and got.count() == 40_000
