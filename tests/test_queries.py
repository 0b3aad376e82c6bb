"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import SF, same

from veritab.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert 0 <= row.acc_at_1 <= row.acc_at_5 <= 1 and row.n > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_placements_keep_their_invariants(spark):
    for r in registry.QUERIES["placements"](spark, SF).collect():
        assert 0 <= r.x0 < r.x1 <= 640 and 0 <= r.y0 < r.y1 <= 480
        assert r.reason in ("near", "mid", "far", "random", "forced")
