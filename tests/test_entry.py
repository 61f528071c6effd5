"""The driver's contract: queries give what their SQL gives."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        out = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=str) == got
