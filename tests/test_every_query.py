from siftwave import queries

from .every_query import failures


def test_every_query(spark):
    """All registered queries of the library run on the given tables and give what their SQL gives."""
    assert failures(spark, queries.queries(), queries.sql()) == {}
