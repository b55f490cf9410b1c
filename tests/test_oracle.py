"""Every registered query against its DuckDB oracle on sf0.001 (exact row multiset)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (4, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan") if isinstance(v, float) and math.isnan(v) else (2, repr(float(v)))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (5, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(rel.columns, rel.fetchall())


def test_every_query_has_oracle_or_is_rows_only():
    """Only queries of the optional training-data part may go without SQL."""
    assert not {q for q in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", q)}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "revenue_ty" in df.columns
