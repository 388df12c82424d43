"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from quarry.plans import catalog

from . import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLE:
        oracle.check(df, catalog.ORACLE[name], SMALL)
    else:
        assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
