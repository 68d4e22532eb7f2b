"""Every query of the subpackage that has SQL, against it."""

import pytest

from millrace.llm import registry
from tests.llm.duck import same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(registry.queries()[name](spark, "/root/testdata/sf0.01"), registry.oracle_sql()[name], "/root/testdata/sf0.01")
