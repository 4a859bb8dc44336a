from oeeforge.llm import cotrain_quality as c


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = c.fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = c.classify(docs, model).where("doc_id % 4 = 0").join(labels, "doc_id").select("quality", "toxic", "keep").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [not r.keep for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(clean) / len(clean) > 0.98 and sum(bad) / len(bad) > 0.9


def test_odd_rows_and_missing_classes(spark):
    docs = spark.createDataFrame([(i, f"plain text number {i}", "s", "en", "k") for i in range(30)] + [(None, None, None, None, "k"), (1, "", "s", "en", "k"), (99, "word " * 40_000, "s", "en", "k")],
                                 "doc_id long, text string, source string, lang string, p_x string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = c.classify(docs, c.fit(docs, none))
    assert out.columns == [*docs.columns, "p_poor", "p_toxic", "keep"] and out.where("keep").count() == docs.count()
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(20)] + [(None, 0, 1), (500, 0, 1), (3, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    some = c.classify(docs, c.fit(docs, labels))
    rows = some.collect()
    assert len(rows) == docs.count() and all(0 <= r.p_poor <= 1 and r.p_toxic == 0 for r in rows)
    assert c.classify(docs.limit(0), c.fit(docs, labels)).count() == 0
    assert c.fit(docs.limit(0), labels).heads["poor"].constant == 0.0


def test_every_unlabelled_row_is_scored_in_every_round(spark, monkeypatch):
    scored = []

    def counted(pool, model, view, head, base, rules, f=c._taught):
        scored.append((head, view, pool.count()))
        return f(pool, model, view, head, base, rules)

    monkeypatch.setattr(c, "_taught", counted)
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    c.fit(docs, labels, c.Rules(rounds=2, max_taught=50))
    unlabelled = docs.join(labels, "doc_id", "left_anti").count()
    assert len(scored) == 8 and {n for *_, n in scored} == {unlabelled}


def test_clashing_columns_repeated_ids_and_equal_rows(spark):
    names = ["doc_id", "text", "source", "p_poor", "keep", "KEEP_", "view_words", "terms", "row", "part", "raw", "tokens"]
    rows = [(i % 40, ("good plain words here " if i % 2 else "bad junk spam trash ") + f"t{i % 8}", "s", *"abcdefghi") for i in range(120)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for out in (c.classify(docs, c.fit(docs, labels)), c.fit_and_classify(docs, labels)):
        assert out.columns == [*names, "p_poor_", "p_toxic", "keep__"]
        got = out.collect()
        assert sorted(tuple(r)[: len(names)] for r in got) == sorted(rows)
        assert len({(r.text, r.p_poor_, r.keep__) for r in got}) == len({r.text for r in got})
        assert all(r.keep__ == r.text.startswith("good") for r in got)
