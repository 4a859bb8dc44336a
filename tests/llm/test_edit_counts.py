import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oeeforge.llm import edit_counts, pretokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pretokens.vocabulary())


def plain(text, edits):
    """The texts after each edit, without the tree."""
    out = []
    for at, removed, inserted in edits:
        at = min(max(at or 0, 0), len(text))
        end = min(at + max(removed or 0, 0), len(text))
        text = text[:at] + (inserted or "") + text[end:]
        out.append(text)
    return out


PIECE = st.text(alphabet="ab,'s1é \n\t<|", max_size=12) | st.sampled_from(["<|endoftext|>", "  ", " ", " word and more", "\n\n"])


@settings(max_examples=250, deadline=None)
@given(st.lists(PIECE, max_size=30).map("".join), st.lists(st.tuples(st.integers(-2, 200), st.integers(-1, 40), PIECE), max_size=8))
def test_counts_equal_encoding_the_whole_text(library, text, edits):
    coder = pretokens.encoder(pretokens.vocabulary())
    own = edit_counts.CountedText(text, coder, coder.chunks([text])[0])
    assert own.tokens == len(library.encode(text, add_special_tokens=False).ids)
    for (at, removed, inserted), after in zip(edits, plain(text, edits)):
        assert own.edit(at, removed, inserted) == len(library.encode(after, add_special_tokens=False).ids)
        assert own.text == after and (own.tree is None or own.tree.characters == len(after))


def test_long_text_encodes_only_what_edits_touch(library):
    rng = np.random.default_rng(1)
    coder = pretokens.encoder(pretokens.vocabulary())
    text = " ".join(f"word{i}" for i in rng.integers(0, 5000, 20_000))
    own, now = edit_counts.CountedText(text, coder, coder.chunks([text])[0]), text
    for k in range(200):
        e = (int(rng.integers(0, len(now))), int(rng.integers(0, 300)), " new, words" * int(rng.integers(0, 120)))
        now = plain(now, [e])[0]
        own.edit(*e)
        assert own.tree.characters == len(now)
    assert own.text == now and own.tokens == len(library.encode(now, add_special_tokens=False).ids)
    assert own.encoded < 200 * 800
    assert all((level.sum(axis=0) == own.tree.levels[-1][0]).all() for level in own.tree.levels)


def test_rows_and_joined_edits(spark, library):
    docs = spark.createDataFrame([(1, "some text here", 5), (2, None, 5), (3, "", 5), (4, "w " * 60_000, 5), (None, "null id", 5), (1, "some text here", 5)],
                                 "doc_id long, text string, seq int")
    edits = [(1, 2, 0, 4, "No"), (1, 1, 4, 0, " more"), (2, 1, 0, 0, "came"), (4, 1, 50_000, 9, None), (3, 1, None, None, "x"), (9, 1, 0, 0, "none")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, at long, removed long, inserted string")
    got = edit_counts.count(edit_counts.with_edits(docs, table)).collect()
    want = []
    for doc_id, text, _ in docs.collect():
        own = [e[2:] for e in sorted(x for x in edits if x[0] == doc_id and doc_id is not None)]
        steps = plain(text or "", own)
        n = [len(library.encode(t, add_special_tokens=False).ids) for t in [text or "", *steps]]
        want.append((doc_id, n[0], n[1:], n[-1], len((steps or [text or ""])[-1])))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert edit_counts.count(edit_counts.with_edits(docs.limit(0), table)).count() == 0


def test_query_equals_the_library(spark, library):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", edit_counts.sample_edits(F.col("text")).alias("edits")).collect()
    got = {r.doc_id: r for r in edit_counts.query(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        steps = plain(r.text, [tuple(e) for e in r.edits])
        n = [len(library.encode(t, add_special_tokens=False).ids) for t in [r.text, *steps]]
        own = got[r.doc_id]
        assert (own.n_tokens, own.after_each, own.n_tokens_edited, own.n_chars_edited) == (n[0], n[1:], n[-1], len(steps[-1]))
