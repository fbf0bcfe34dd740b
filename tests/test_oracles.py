"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from agentlake.plans import all_queries
from check import compare, duck

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "sessions", "avg_iterations", "avg_tokens", "avg_score"]
    assert df.count() > 0


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, sf_dir, name):
    text, _, good = compare(spark, con, sf_dir, name)
    assert good, text


