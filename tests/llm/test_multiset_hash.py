import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oeeforge.llm import multiset_hash as m

TEXT = st.lists(st.sampled_from(["a b c", "d e", "", "f", "a b", "long line of many words here"]), max_size=6).map("\n".join)


def one(text):
    return m.pack(*m.vectors([text]))[0]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.randoms())
def test_order_of_paragraphs_does_not_matter(text, rnd):
    parts = text.split("\n")
    rnd.shuffle(parts)
    if text:
        assert one("\n".join(parts)) == one(text) or "\n".join(parts) == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT.filter(bool), min_size=1, max_size=4))
def test_insertion_and_deletion_are_incremental(texts):
    whole = m.vectors(["\n".join(texts)])
    step = m.vectors([texts[0]])
    for t in texts[1:]:
        step = m.insert(step, [t])
    assert all((a == b).all() for a, b in zip(whole, step))
    back = m.insert(step, [texts[-1]], -1)
    rest = m.vectors(["\n".join(texts[:-1])]) if len(texts) > 1 else m.vectors([""])
    assert all((a == b).all() for a, b in zip(rest, back))


def test_batches_do_not_matter(monkeypatch):
    texts = ["", "a", "\n\n", "x y\nz", "word " * 3000, "é\nß ü", " ", "a\tb\nc"]
    together = m.pack(*m.vectors(texts))
    assert together == [one(t) for t in texts]
    monkeypatch.setattr(m, "SLICE", 5)
    assert m.pack(*m.vectors(texts)) == together
    assert len(set(together)) == len(texts)


def test_likeness_follows_the_shared_words():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    a = m.vectors([" ".join(words)])
    for share in (0.25, 0.5, 0.75, 0.9):
        k = int(4000 * share)
        b = m.vectors([" ".join(words[:k] + [f"v{i}" for i in range(4000 - k)])])
        assert m.likeness(a, b)[0] == pytest.approx(share, abs=0.2)
    assert m.likeness(a, a)[0] == 1.0 and m.likeness(m.vectors([""]), m.vectors([""]))[0] == 1.0
    assert m.likeness(m.vectors([""]), a)[0] == 0.0


def test_likeness_of_many_equal_runs():
    for n in (32_000, 40_000, 70_000):
        a = m.vectors(["word " * n])
        b = m.vectors(["word " * (n - n // 4) + " ".join(f"v{i}" for i in range(n // 4))])
        assert m.likeness(a, b)[0] > 0.9 and m.likeness(m.unpack(m.pack(*a)), m.unpack(m.pack(*b)))[0] > 0.9


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edits_equal_brute_force(spark, parts):
    rows = [(5, "five words are in here\nand a second line", 1), (None, "null id " * 9, 1), (9, None, 2), (9, "", 2), (12, "ab", 1), (7, "x\n" * 500, 1),
            (7, "x\n" * 500, 1), (2**40, "far\naway\n", 1), (-3, "minus\n\nthree is first", 1), (20, "very long text here\n" * 10_000, 1), (21, "abcd\nefgh", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = m.edited(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((-(2**63) if i is None else i, t or "", i) for i, t, _ in rows), key=lambda r: (r[0], r[1].encode()))
    want = []
    for k, (_, text, doc_id) in enumerate(order):
        after, q = order[(k + 1) % len(order)][1], len(text) // 4
        e = text[: len(text) - q] + after[:q]
        a, b, c = m.vectors([text]), m.vectors([e]), m.vectors([after])
        want.append((doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), m.pack(*a)[0], m.pack(*b)[0], m.likeness(a, b)[0], m.likeness(a, c)[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.edited(docs).count() == 0 and m.fingerprints(docs).count() == 0
    one_row = m.edited(spark.createDataFrame([(1, "alone here\nx")], docs.schema)).collect()
    assert one_row[0].near_next == 1.0 and one_row[0].fingerprint == one("alone here\nx")
