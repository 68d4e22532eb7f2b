"""Every registered query that has SQL, against it, over whole tables."""

import pytest

from millrace.plans import registry
from tests.duck import same_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
