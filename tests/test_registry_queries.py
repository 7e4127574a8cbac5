import pytest

from regolith.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) is None
