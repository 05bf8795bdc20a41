from pathlib import Path

import duckdb
import pytest

from docquarry.llm import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)
