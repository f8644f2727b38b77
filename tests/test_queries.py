import pytest

from parcelworks.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracles()[name])
