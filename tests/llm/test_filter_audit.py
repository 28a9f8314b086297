import itertools
import re
from collections import Counter

import duckdb

from accordant.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Plain loops: docs are (id, text, part), labels (id, quality, toxic)."""
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((part or "", {f for f, x in failed.items() if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = Counter()
    shapley = Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                fails = [r for r in rows if r[0] == part and letter in r[1]]
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), len(fails) - len(gone), sum(r[1] == {letter} for r in fails),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def rows_of(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (None, LONG, "en"), (4, None, "fr"), (5, "", "fr"), (6, "A" * 40, "de"),
    (7, "a b a b a b " * 40, "de"), (8, LONG + " #", "en"), (9, "x\x0by\x1cz  \t|" * 30, ""), (10, "ÀÉ É B", "en"), (-3, "x y", "fr"), (4, "x y", "fr"),
    (11, (LONG + "\n") * 3, "en"), (12, (LONG + "\n") * 3, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (7, 1, 1), (99, 1, 1), (None, 1, 1), (12, 1, 0)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 5) for r in docs], "doc_id long, text string, lang string, mask string, key int")
    return d, spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_equals_plain_loops_on_hard_rows(spark):
    want = brute(DOCS, LABELS)
    for long_chars in (1 << 20, 50, -1):
        assert rows_of(filter_audit.audit(*frames(spark, DOCS, LABELS), long_chars=long_chars)) == want


def test_empty_tables(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert rows_of(filter_audit.audit(docs, labels.limit(0))) == brute(DOCS, [])


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    want = con.sql(filter_audit.ORACLE)
    at = [want.columns.index(c) for c in COLUMNS]
    assert rows_of(filter_audit.op11_query(spark, folder)) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
