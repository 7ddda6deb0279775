import corpus_pipeline
from siftwave.llm import queries

from ..every_query import failures


def test_every_query(spark):
    """All operators and the pipeline run on the given tables, and give what their SQL gives where they have one."""
    assert failures(spark, queries.QUERIES | {"pipeline": corpus_pipeline.run}, queries.SQL) == {}
