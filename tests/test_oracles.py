"""Every registered query of the package against its SQL, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cuelake.plans import queries as own

SF = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NA or x != x:
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sql, name):
    got = own.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in own.ORACLES:
        assert rows(got) == rows(sql.sql(own.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry_without_the_llm_folder():
    import __spark_entry__ as entry

    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
