"""Every registered query but the two model grids runs at sf0.001 and matches its SQL."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

# hundreds of model fits each; tests/test_experiment.py runs small grids of the same code
SLOW = {"random_forest_grid", "smote_plus_grid"}


def _duck(sf):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert sum(r.n for r in rows) == 87


def _rows(names, rows):
    """Rows with columns in name order, numbers rounded, in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF001)
    got = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    res = _duck(SF001).execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, res.fetchall())
