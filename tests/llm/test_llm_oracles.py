import pytest

from pixelloom.llm import queries


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])
