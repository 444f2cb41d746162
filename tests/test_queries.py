from __future__ import annotations

import pytest

from postloom import catalog
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    said = compare(spark, name, SMALL)
    assert not said or said.startswith("rows only")
