"""The catalogue of queries: all have SQL or a test, and the flagship runs."""

import __spark_entry__
from lodestone.queries import QUERIES, SQL


def test_every_engine_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "score"] and found.count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
