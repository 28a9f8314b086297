import json
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from accordant.llm import token_store as ts
from accordant.llm.common import workspace

ENC = ts.Encoder(ts.default_tokenizer(), "<u2")
TOK = Tokenizer.from_file(ts.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aB'sSİΣς éÉßẞÿŸſ²½×÷ªµIıŉ!_0rRelL é\u0301\u200b\u3000\t\n\x1c<|>12.日", "<|endoftext|>"]), max_size=60).map("".join))
def test_words_give_the_whole_texts_ids(text):
    assert np.frombuffer(ENC.encode([text])[0], '<u2').tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 1]


def test_every_plain_character_and_pairs_of_them():
    chars = [chr(c) for c in range(0x180)]
    texts = chars + [a + b for a in chars[::5] for b in chars[::3]] + ["i'll we've I'M x's'", "a_b__c", "x<|endoftext|>y", "1234,5"]
    for text, ids in zip(texts, ENC.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 1], repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    mph = ts.MinimalPerfectHash.build(keys)
    assert sorted(mph(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("shard_bytes", [1, 500, 64 << 20])
def test_files_round_trip(spark, shard_bytes):
    rng = np.random.default_rng(3)
    rows = [(int(i), "word " * int(n) + f"nr {i}") for i, n in zip(rng.permutation(300) * 7, rng.integers(0, 30, 300), strict=True)]
    rows += [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (14, None), (21, ""), (0, "zero"), (-(2**63), "least"), (2**63 - 1, "most")] + [(35, f"hot {i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, _text string")
    folder = workspace(spark, "t")
    index = ts.write_shards(docs, folder, shard_bytes=shard_bytes)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.read_shards(index, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = sorted((k is not None, k, zlib.crc32(np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for k, t in rows)
    assert sorted((r[0] is not None, r[0], r[3]) for r in got) == want
    assert len(ts.lookup(index, folder, 35)) == 41 and len(ts.lookup(index, folder, None)) == 2
    assert ts.lookup(index, folder, 36) == [] and len(ts.lookup(index, folder, 0)) == 2 and len(ts.lookup(index, folder, -(2**63))) == 1
    assert ts.lookup(index, folder, 14)[0].tolist()[-1] == 1
    shards = index.filter("tokens is not null")
    assert shards.agg({"documents": "sum"}).first()[0] == len(rows) and (shards.count() > 100) == (shard_bytes == 1)


def test_rows_come_through_the_index(spark):
    """A shard whose stored fingerprints or places are damaged gives errors and not the same rows."""
    folder = workspace(spark, "t")
    index = ts.write_shards(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"), folder)
    path = next(Path(folder.removeprefix("file://")).glob("*.tok"))
    shard, raw = ts.Shard(f"{folder}/{path.name}"), path.read_bytes()
    at = len(ts.MAGIC) + sum(shard.head["bytes"][k] for k in ("ids", "lengths", "keys", "words", "ranks"))
    size = shard.head["bytes"]["fingerprints"]
    path.write_bytes(raw[:at] + bytes(255 - x for x in raw[at : at + size]) + raw[at + size :])
    with pytest.raises(Exception, match="hasn't the key"):
        ts.read_shards(index, folder).collect()
    path.write_bytes(raw[:-3])
    with pytest.raises(Exception, match="no token shard"):
        ts.read_shards(index, folder).collect()


def test_another_tokenizer_is_used_whole(tmp_path):
    rules = json.loads(TOK.to_str())
    assert ts.Encoder.is_known(rules)
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]
    assert not ts.Encoder.is_known(rules)
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    text = "Some TEXT with Capitals"
    got = np.frombuffer(ts.Encoder(str(path), "<u2").encode([text])[0], "<u2").tolist()
    assert got == [*Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids, 1]
    assert got != np.frombuffer(ENC.encode([text])[0], "<u2").tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = workspace(spark, "t")
    assert ts.read_shards(ts.write_shards(docs, folder), folder).count() == 0


def test_words_that_recur_are_remembered(monkeypatch):
    """A full memory forgets only what came once, and ids stay right whatever goes."""
    monkeypatch.setattr(ts, "REMEMBERED_WORDS", 40)
    enc = ts.Encoder(ts.default_tokenizer(), "<u2")
    for i in range(30):
        texts = [f"Often seen, Été {'x' * i}y", f"rare{i} Rare{i}'s odd{i}日", ""]
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(texts)] == [[*TOK.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert len(enc.known) <= 40 + 20
    assert {"Often", "seen,", "Été"} <= set(enc.known) and "Rare1's" not in enc.known
    every = [f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8]}" for i in range(64)]
    for _ in range(3):
        enc.encode([" ".join(every)])
    enc.encode(["one"])
    assert set(enc.known) == {"one"}


def test_a_long_text_is_not_taken_apart_into_objects():
    """Memory follows the text's bytes; string objects for words took 26 times these."""
    code = (
        "import resource, sys; from accordant.llm import token_store as ts; e = ts.Encoder(ts.default_tokenizer(), '<u2'); text = 'many words ' * 4_000_000\n"
        "e.encode(['many words']); peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = peak(); n = len(e.encode([text])[0]); print(n, (peak() - a) * 1024 / len(text))"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(ts.__file__).parents[2])
    n, times = said.stdout.split()
    assert int(n) == 2 * 8_000_000 + 2 and float(times) < 9, said
