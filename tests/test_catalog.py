"""Every query beside its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog.compare import normal
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert len(mine) >= 0
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(tuple(normal(v) for v in r) for r in duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]}) q").fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "lang", "n_entities", "text_out"]
