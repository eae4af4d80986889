"""Every query of the reference's operators against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sourcegrove.plans.queries import ORACLE_SQL, QUERIES


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(flat(r[names.index(c)]) for c in cols) for r in cur.fetchall()) == got
