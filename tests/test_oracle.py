"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, differences

from docweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.load()))
def test_query(spark, con, name):
    df = catalog.load()[name](spark, SF)
    if name in catalog.check_sql():
        assert differences(df, con, catalog.check_sql()[name]) == []
    else:
        assert df.count() > 0
