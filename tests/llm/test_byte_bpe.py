import hashlib

import numpy as np
import pytest

from accordant.llm import byte_bpe

SCHEMA = "doc_id long, text string, ids string, _row string, _no string"
HARD = [
    "", None, "a", "  ", "\n\n\n", "don't we'll they're  'tis x's", "tab\t\tend \n next", "日本語 text 混在 ١٢٣ émigré", "\U0001f600" * 40,
    "a" * 700, " " * 700, "word " * 300, "x  \n y" * 200, "'r" * 150 + "e'll", "1234 " * 90 + "\n" * 60 + "z", "<|endoftext|> [INST]", "é" * 99 + "'s",
]


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 10), (64, 40), (32_768, 512)])
def test_equals_the_library_on_whole_texts(spark, chunk, overlap):
    enc = byte_bpe.encoder(*byte_bpe.default_vocabulary())
    rows = [(i % 5 if i % 7 else None, x, "clash", "clash", "clash") for i, x in enumerate(HARD * 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = byte_bpe.encode(docs, ["doc_id", "text"], chunk=chunk, overlap=overlap).collect()
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r[:2])
    want = [(a, b, np.array(enc.encode_ordinary(b or ""), "<u4").tobytes()) for a, b, *_ in rows]
    # null texts come back as the empty texts that they count as
    assert sorted((str(r.doc_id), r.text or "", bytes(r.ids)) for r in got) == sorted((str(a), b or "", c) for a, b, c in want)
    assert key


def test_long_texts_are_cut_in_parallel(spark):
    text = "Some words, don't they  run\non? " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = byte_bpe.chunked_pieces(docs, ["doc_id"], "text", byte_bpe.default_vocabulary()[1], 1000, 100).orderBy("_no").collect()
    assert len(pieces) > 100
    assert "".join(p._text for p in pieces) == text


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.encode_digests(docs).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256("héllo wörld".encode()).hexdigest()
    assert (got[2].n_tokens, got[2].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert byte_bpe.encode_digests(docs.limit(0)).count() == 0
