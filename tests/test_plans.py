"""Every prepared query against its SQL on the smallest tables."""

import pytest

from tabularium import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(name, spark, sf, duck, same_rows):
    same_rows(plans.QUERIES[name](spark, sf), duck, plans.ORACLES[name])
