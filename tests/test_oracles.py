"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from keelson.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def tidy(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
            return ""
        return str(round(float(value), 6)) if isinstance(value, (int, float)) and not isinstance(value, bool) or hasattr(value, "dtype") and value.dtype.kind in "iuf" else str(value)

    return sorted(tuple(map(plain, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_rows_equal(name, spark, duck):
    got, want = QUERIES[name].run(spark, SF).toPandas(), duck.sql(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)
