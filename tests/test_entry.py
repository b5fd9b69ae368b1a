"""Driver contract: entry() runs on sf0.001; every query of the registry has its SQL."""

import __spark_entry__ as E
from evalloop.plans.registry import REGISTRY

def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["scope", "dataset", "k", "n", "pass_at_1", "pass_at_k"]


def test_every_registered_query_has_its_sql():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(REGISTRY) <= set(sql) <= set(qs)
