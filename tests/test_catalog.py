"""Every registered query with SQL, outside the corpus operators, against DuckDB at the smallest size."""

import pytest
from oracle import assert_same

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    assert assert_same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], DATA)
