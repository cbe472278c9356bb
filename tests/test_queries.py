"""Every query of the study chain against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from stillwater.plans import registry

SF = "/root/testdata/sf0.001"

# names that share a function and SQL are one case
CASES = {(registry.QUERIES[name], sql): name for name, sql in registry.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in (value.asDict().values() if hasattr(value, "asDict") else value))
    return value


def rows(names, values):
    by_name = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(row[k]) for k in by_name) for row in values)


@pytest.mark.parametrize("name", sorted(CASES.values()))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_names_of_one_function_are_one_case():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert len(CASES) <= len(registry.ORACLE)


def test_flagship_is_the_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
