import corpus_pipeline
from oeeforge.llm import common

TOXIC = "trash pathetic idiot worthless disgusting".split()


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    whole, items = {r.doc_id: r.text for r in docs.collect()}, [r.text for r in common.table(spark, sf, "benchmark").collect()]
    labels = {r.doc_id: r for r in common.table(spark, sf, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stage_table(stage(spark, docs, sf), "test-stage")
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        before, rows = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before)
        if name == "quality classifier":
            clean = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
            bad = [i for i, x in labels.items() if x.quality == 0]
            assert sum(i in rows for i in clean) > 0.97 * len(clean) and sum(i in rows for i in bad) < 0.2 * len(bad)
        elif name == "line dedup":
            assert set(rows) == set(before) and any(rows[i].text != whole[i] for i in rows)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "n-gram jaccard join":
            texts = [r.text for r in rows.values() if r.text.split()]
            assert len({" ".join(t.lower().split()) for t in texts}) == len(texts) and len(rows) < len(before)
        else:
            held = {i for i, r in before.items() if any(t in r.text for t in items)}
            assert held and not held & set(rows) and len(rows) >= len(before) - len(held) - 3
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r.same_text for r in last)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_kept", "_place", "keep", "lines_total", "row", "members", "kept_id"]


def frame(spark, rows):
    extra = [7, "p", "k", 1, "r", "m", "i"]
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept int, "
                                 "_place string, keep string, lines_total int, row string, members string, kept_id string")


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "some text that stands here twice", "en", "s", 32), (1, "some text that stands here twice", "en", "s", 32), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, "text without id", "en", "s", 15), (4, "Some text that\tstands here twice", "en", "s", 32), (5, "long " * 30_000, "en", None, None)]
    docs, sf = frame(spark, rows), "/root/testdata/sf0.001"
    quality = common.stage_table(corpus_pipeline.STAGES[0][1](spark, docs, sf), "test-stage")
    assert quality.columns == COLUMNS and {tuple(r)[5:] for r in quality.collect()} <= {(7, "p", "k", 1, "r", "m", "i")}
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = common.stage_table(stage(spark, docs, sf), "test-stage")
        assert docs.columns == COLUMNS and {tuple(r)[5:] for r in docs.collect()} == {(7, "p", "k", 1, "r", "m", "i")}
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "5", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 5


def test_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage_table(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        assert docs.columns == COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 0
