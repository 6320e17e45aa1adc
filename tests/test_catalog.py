"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from wayfold.catalog import entries
from wayfold.catalog.sources import TABLES

KNOWN = entries()
# Runs of more than an hour; WAYFOLD_LONG=1 includes them.
LONG = {"learn_full_search"}


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"d{value + 0.0!r}"
    return f"{type(value).__name__}{value}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", list(KNOWN))
def test_query(name, spark, duck, tiny):
    if name in LONG and not os.environ.get("WAYFOLD_LONG"):
        pytest.skip("about 400,000 jobs; WAYFOLD_LONG=1 runs it")
    df = KNOWN[name].run(spark, tiny)
    rows = [tuple(r) for r in df.collect()]
    if KNOWN[name].sql is None:
        assert rows
        return
    answer = duck.execute(KNOWN[name].sql)
    assert normal(df.columns, rows) == normal([c[0] for c in answer.description], answer.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"eid", "step", "delay_severity", "label"} <= set(df.columns)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
