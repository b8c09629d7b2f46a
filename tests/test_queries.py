"""Every query of the catalog runs; those with SQL equal DuckDB's result."""

from __future__ import annotations

import pytest

from folio.plans import catalog
from tests.comparing import TABLES, both, oracle

SF = f"{TABLES}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        got, want = both(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)
        assert got == want
    else:
        assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
