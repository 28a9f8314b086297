"""Every query with SQL equals it on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, Decimal):
        x = float(x)
    return round(x, 4) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    names, rows = want.columns, want.fetchall()
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(value(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(value, r)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
