"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(value(r[k]) for k in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, sf, name):
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["profile_lineitem", "profile_bigint", "profile_wide_safe", "quantiles_lineitem", "associations_spearman", "vocabulary_groups", "absence_by_threshold"])
def test_query_on_the_larger_tables(spark, name):
    test_query(spark, connect(sf := "/root/testdata/sf0.01"), sf, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 8
