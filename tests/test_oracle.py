"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import sys

import duckdb
import pytest

from barlight.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return round(float(value), 6) + 0.0


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall()
    assert rows(got.select(*columns).collect()) == rows(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_folder(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "barlight.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
