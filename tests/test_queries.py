"""Every query of the engine's own operators against its SQL; those without SQL run and have a stable schema."""

import pytest

from oracle import assert_same
from tessellar import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, sf, name):
    assert_same(plans.QUERIES[name], plans.SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    frame = plans.QUERIES[name](spark, sf)
    assert frame.count() > 0
