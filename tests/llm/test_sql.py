"""Queries that SQL can express, against their SQL; and names, columns and types of all."""

import pytest

from folioscan.llm import queries
from tests.oracle import connected, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark):
    same(queries.QUERIES[name](spark, SF), connected(SF), queries.oracle_sql()[name])


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
