import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oeeforge.llm import piece_codec


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], own.dtype).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeinrst,.é\n\t  ▁𐍈", max_size=60))
def test_ids_are_the_library_s(library, text):
    own = piece_codec.codec(piece_codec.model_file())
    assert ids_of(own, text) == library.encode(text)
    if "▁" not in text:
        assert own.decode(np.array(ids_of(own, text), int)) == text


def test_words_share_prefixes_without_changing_their_ids(library):
    own = piece_codec.Codec(piece_codec.model_file())
    words = ["▁" + w for w in ("in", "inter", "international", "internationally", "interne", "intern", "i", "a" * 500, "zzz")]
    together = own.encode_words(words)
    for w in words:
        assert together[w] == piece_codec.codec(piece_codec.model_file()).encode_words([w])[w]
        assert np.frombuffer(together[w], own.dtype).tolist() == library.encode(w[1:])


def test_rows_stay_one_to_one(spark, library):
    rows = [(1, "Hi  there\n\nyou", 7), (None, "x", 7), (2, None, 7), (2, "", 7), (3, "same", 7), (3, "same", 7), (4, "long text " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = piece_codec.decode(piece_codec.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text) and r.n_pieces * 4 == len(r.ids)
    assert all(r.same_text for r in piece_codec.digest(piece_codec.decode(piece_codec.encode(docs))).collect())
    assert piece_codec.encode(spark.createDataFrame([], docs.schema)).count() == 0


def test_query_covers_the_table(spark, library):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = piece_codec.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(r.same_text for r in got)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(library.encode(docs[r.doc_id]), "<u4").tobytes())
