"""Every query of this subpackage that has SQL equals it."""

import pytest
from compare import compare, connect

from sessionloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), Q.QUERIES[name], Q.ORACLE[name], sf_dir) is None
