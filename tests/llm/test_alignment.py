import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from accordant.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "x\n y\n\n z \n", "tab\t end\t\tx", "émigré naïve, don't 'tis", "日本語 text 混在 ١٢٣",
    "▁a b", "a ▁", "</s> <s> <unk> <|endoftext|> <0x41>", "\U0001f600" * 5 + " x", "\x00 \x1c a\x1f b", "word " * 400, "1234 " * 50 + "z",
    "a b   c　d", "the the the cat", "ﬁ ﬂ é", "z" * 300, "a\r\n b \r\nc",
]


def brute(rows):
    """Whole texts through both libraries, and plain loops."""
    path_a, path_b = alignment.default_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    done, counts = [], Counter()
    for key, text in rows:
        text = text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            done.append((key, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: n + 1])) for n in range(len(x))] for x in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in common]
        groups = []
        for low, high in zip([0, *common], common, strict=False):
            some = [[str(i) for i, e in zip(x, y, strict=True) if low < e <= high] for x, y in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(map(",".join, some)))
        counts.update(links)
        done.append((key, ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            str(key), len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for key, x, y, groups, links in done
    )


def told(frame):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS[1:])) for r in frame.collect())


@pytest.mark.parametrize(("block_links", "slice_chars"), [(1 << 20, 1 << 18), (20, 7), (1, 1)])
def test_equals_plain_loops_on_hard_texts(spark, block_links, slice_chars):
    rows = [(n % 9 if n % 4 else None, x) for n, x in enumerate(HARD * 2)]
    docs = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], "doc_id long, text string, key string, places string, block int")
    got = alignment.link_figures(docs.repartition(3), block_links=block_links, slice_chars=slice_chars)
    assert got.columns == COLUMNS
    assert told(got) == brute(rows)


def test_query_equals_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert told(alignment.op13_query(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_empty_table_and_other_keys(spark):
    docs = spark.createDataFrame([("k", "a b")], "name string, body string")
    assert alignment.link_figures(docs.limit(0), "name", "body").count() == 0
    (row,) = alignment.link_figures(docs, "name", "body").collect()
    assert (row.name, row.n_groups, row.n_links, row.n_best, row.count_sum) == ("k", 2, 2, 2, 2)


def test_memory_is_emptied(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    tools = alignment.Aligner(*alignment.default_tokenizers())
    alone = alignment.align("one two three four five", tools)
    assert not tools.known and alone == alignment.align("one two three four five", tools, 4)
