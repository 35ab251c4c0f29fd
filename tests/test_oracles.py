import pytest

from pixelloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, same):
    same(QUERIES[name], ORACLES[name])


def test_entry_has_rows(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
