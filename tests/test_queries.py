"""Every registered query against its SQL on the smallest tables."""

import pytest

from siltstone.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, oracle.sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Queries without SQL, on larger tables than the others: odd texts are few."""
    QUERIES[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "corpus_id", "chunk_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
