"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from gleaner.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    names, got = oracle.rows(catalog.QUERIES[name](spark, SF))
    if name in catalog.ORACLE_SQL:
        assert (names, got) == oracle.expected(con, catalog.ORACLE_SQL[name])
    else:
        assert got
