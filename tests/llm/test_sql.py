"""Queries of this subpackage against their SQL."""

import pytest

from quire.llm import registry
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) > 0


def test_all_are_registered():
    assert sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
