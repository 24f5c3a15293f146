"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(value):
    return str(value) if isinstance(value, decimal.Decimal) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries())


def test_classes_as_in_sql_beyond_ascii(spark, duck, tmp_path):
    """Words that go on in other letters, other blanks, and capitals that only Unicode folds."""
    texts = ["Doó ciónado", "do", "DO $$", "do_x", "\x0bdo x", "\u00a0do x", "\t\n\f\r do", "W\u0130TH x", "\u0130", "set\u0301 x", "select\u00df", "comment\x0bon x", "comment \n on x", "", None]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = duckdb.connect()
    own.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(own.sql(ORACLE_SQL["classify_text"]).fetchall())
    assert sorted(map(tuple, QUERIES["classify_text"](spark, str(tmp_path)).collect())) == want
    assert {c for *_, c in want} >= {"DO", "SELECT", "COMMENT", "UNKNOWN"}
