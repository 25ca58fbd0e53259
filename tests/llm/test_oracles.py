from __future__ import annotations

import os

import pytest

from labelframe.llm import queries
from test_bindings import SF, compared

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compared(spark, queries.QUERIES[name], queries.ORACLES[name])
