import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oeeforge.llm import pretokens, token_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pretokens.vocabulary())


ODD = ["", "a", " ", "  ", "a  b", "\n\n a", "tail \n", "tab\tx  y\r\n z", "x y", " em space", "don't  it's",
       "<|endoftext|> a <|endoftext|>", "é𐍈 ß", "a" * 30_000, "1 22 333 4444", " lead", "end ", "!\x1c x", "word " * 500]


def test_encoder_equals_the_library(library):
    own = pretokens.Encoder(pretokens.vocabulary())
    for _ in range(2):
        for text, ids in zip(ODD, own.encode(ODD)):
            assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,.'s1é\n\t\r   <|>", max_size=40))
def test_encoder_equals_the_library_on_any_text(library, text):
    own = pretokens.encoder(pretokens.vocabulary())
    assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.arange(n, dtype=np.int64) * 7919 - 300
    slots = token_file.Slots(*token_file.minimal_perfect_hash(keys))
    assert sorted(slots.all(keys).tolist()) == list(range(n))
    assert [slots.one(int(k)) for k in keys[:50]] == slots.all(keys)[:50].tolist()


def test_files_round_trip_with_nulls_ties_and_extra_columns(spark, library):
    rows = [(5, "b c", 1), (None, "x", 1), (3, None, 1), (3, "a", 1), (3, "a", 1), (-7, "", 1), (2**40, "long " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    manifest = token_file.write(docs, shards=3)
    got = sorted(token_file.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -7, 3, 3, 3, 5, 2**40]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = {k: sorted(library.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows if i == k) for k in (5, None, 3, -7, 2**40)}
    files = manifest.collect()
    for key, ids in want.items():
        assert sorted(x.tolist() for x in token_file.lookup(files, key)) == ids
    assert token_file.lookup(files, 4) == [] and token_file.lookup(files, 6) == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file.read(token_file.write(docs)).count() == 0


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in token_file.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
