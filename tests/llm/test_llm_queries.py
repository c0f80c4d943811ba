"""Every query of the training-data operators against its SQL."""

import os

import pytest

from lemmaflow.llm import queries
from tests.compare import BASE, check

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    check(spark, queries, name)


def test_queries_without_sql_are_scored_elsewhere():
    assert queries.QUERIES.keys() - queries.ORACLE.keys() == {"p1_pieces", "p5_found", "p5_restored", "p7_ids", "p9_found"}
