"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as ent
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = ent.entry(spark)
    assert df.columns == ["type", "id", "delta", "value"]
    assert df.count() == 20


def test_every_query_has_an_oracle():
    """A query without SQL is a training-data operator with a named test
    against brute force (tests/llm/brute_force.py)."""
    qs, orc = ent.queries(), ent.oracle_sql()
    assert set(orc) <= set(qs) and set(qs) - set(ent.LLM_QUERIES) <= set(orc)
    without = set(qs) - set(orc)
    if without:
        from tests.llm import brute_force
        assert without == set(brute_force.TESTS)
        for module, test in brute_force.TESTS.values():
            assert callable(getattr(importlib.import_module(f"tests.llm.{module}"), test))


@pytest.mark.parametrize("name", sorted(ent.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = ent.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = ent.oracle_sql().get(name)
    if sql is None:
        # Its rows are tested by what tests/llm/brute_force.py names; here
        # it has to run over the whole table.
        assert len(rows) > 0
        pytest.skip("no SQL: rows are compared by its test in tests/llm")
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(rows, df.columns) == _canon(drows, dcols)
