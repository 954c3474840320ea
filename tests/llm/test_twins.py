"""Queries that SQL can express against their DuckDB twins."""

import pytest

from check import compare, connect
from revtide.llm.oracles import ORACLES
from revtide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin_agrees(spark, con, name):
    found = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert found in (None, "no rows") if name == "op5_decontamination" else found is None
