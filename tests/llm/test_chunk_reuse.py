import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from accordant.llm import chunk_reuse
from accordant.llm.token_store import default_tokenizer

rng = random.Random(5)
WORDS = ["Alpha", "béta", "don't", "GAMMA,", "é́tude", "<|endoftext|>", "x1y2", "日本語", "ﬁn", "…"]
SHARED = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(900))
HARD = [
    "", None, " ", "a", "a  b\n\nc", "z" * 5_000, "ab" * 30_000, "日本語テキスト" * 700, "é" * 999 + " x", "<|startoftext|>" * 200, "\t".join(WORDS * 90),
    "Å " * 400, "x y z " * 300, "'s't" * 700, SHARED, "before " + SHARED, SHARED[37:] + " after", SHARED * 3, "q" + SHARED[500:4_000],
    "".join(rng.choice("ab \n'") for _ in range(6_000)), "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(9_000)),
]


def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.mark.parametrize("part_chars", [1 << 24, 1])
def test_equals_the_library_on_whole_texts(spark, part_chars):
    rows = [(n % 7 if n % 5 else None, x, "clash", 1, 2) for n, x in enumerate(HARD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int, hash int").repartition(5)
    whole = library()
    want = sorted((str(k), x or "", whole.encode(x or "", add_special_tokens=False).ids) for k, x, *_ in rows)
    got = chunk_reuse.encode(docs, ["doc_id", "text"], part_chars=part_chars).collect()
    assert sorted((str(r.doc_id), r.text or "", np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


def test_short_chunks_and_hard_joins(monkeypatch):
    monkeypatch.setattr(chunk_reuse, "BITS", 1)
    monkeypatch.setattr(chunk_reuse, "LEAST", 1)
    monkeypatch.setattr(chunk_reuse, "WINDOW", 2)
    monkeypatch.setattr(chunk_reuse, "REACH", 2)
    monkeypatch.setattr(chunk_reuse, "MOST", 5)
    tools, whole = chunk_reuse.ChunkEncoder(default_tokenizer()), library()
    texts = [x for x in HARD if x]
    for text, ends in zip(texts, chunk_reuse.chunk_ends(texts), strict=True):
        assert "".join(chunk_reuse.chunks_of(text, ends)) == text
        ids = tools.joined(text, ends, tools.encoded(chunk_reuse.chunks_of(text, ends)))
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_stretch_widens_until_it_agrees():
    tools = chunk_reuse.ChunkEncoder(default_tokenizer())
    text = "one two three four five six"
    plain = tools.plain
    # Chunks that (wrongly) have other ids for the nearest word: the stretch goes on to where both agree, here the whole text.
    tools.plain = lambda texts: [b"\xff" * 8 if x and x in text and len(x) < 12 else y for x, y in zip(texts, plain(texts), strict=True)]
    ids, whole = tools.repaired(text, 8, 13)
    assert whole and ids == plain([text])[0]
    tools.plain = plain
    assert tools.repaired(text, 8, 13) == (plain(["three"])[0], False)


def test_shared_passages_have_shared_chunks():
    ends = chunk_reuse.chunk_ends([SHARED, "some other words before it: " + SHARED])
    a, b = (set(chunk_reuse.chunks_of(t, e)) for t, e in zip([SHARED, "some other words before it: " + SHARED], ends, strict=True))
    assert len(a & b) >= len(a) - 2 and len(a) > 5


def test_shared_chunks_are_encoded_once(spark):
    rows = [(1, 0, SHARED), (2, 1, SHARED), (3, 2, "x " + SHARED)]
    cut = spark.createDataFrame(rows, "doc_id long, part long, text string").collect()
    names = {}
    for r in cut:
        (ends,) = chunk_reuse.chunk_ends([r.text])
        for c in chunk_reuse.chunks_of(r.text, ends):
            names.setdefault(c, set()).add(r.part)
    shared = [c for c, parts in names.items() if len(parts) > 1]
    docs = spark.createDataFrame(rows, "doc_id long, part long, text string").repartitionByRange(3, "doc_id")
    seen = []
    keep = chunk_reuse.by_part
    try:
        chunk_reuse.by_part = lambda df, name: seen.append((name, df.count())) or keep(df, name)
        chunk_reuse.encode(docs, ["doc_id"], part_chars=1).count()
    finally:
        chunk_reuse.by_part = keep
    asks, answers = dict(seen)["chunk-asks"], dict(seen)["chunk-answers"]
    assert asks == len(shared)
    assert answers == sum(len(names[c]) for c in shared)


def test_query_equals_the_library(spark):
    whole = library()
    got = {r.doc_id: r for r in chunk_reuse.op12_query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = whole.encode(d.text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))


def test_empty_table(spark):
    assert chunk_reuse.encode(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], digest=True).count() == 0
