"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidelog.queries import ORACLES, QUERIES


#: Without rows on small tables; test_plans.py has cases of their own.
SPARSE = ("life_event_effect",)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df, columns: list[str]) -> list[tuple]:
    def value(x):
        if pd.isna(x):
            return "null"
        return f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in row) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, db):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = db.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    assert len(got) or name in SPARSE
    assert rows_of(got, columns) == rows_of(want, columns)
