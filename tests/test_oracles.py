"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from gneiss.plans import catalogue

from .conftest import SF


def normal(rows):
    return sorted(repr(tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n in catalogue.ORACLES))
def test_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    expected = db.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert normal(df.select(*columns).collect()) == normal(expected.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n not in catalogue.ORACLES and n != "scan_builtin"))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
