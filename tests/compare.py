"""Compares a Spark result with SQL run by DuckDB over the same tables."""

import duckdb
import pandas as pd

from tests.conftest import DATA


def oracle(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con.sql(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, bool) or str(type(v)).find("bool") >= 0:
            return str(bool(v))
        try:
            return f"{float(v):.6g}" if not isinstance(v, str) and float(v) != int(v) else str(int(v)) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
