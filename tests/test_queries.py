"""Every query of the core against its SQL."""

import os

import pytest

import __spark_entry__
from lemmaflow.plans import fixtures, general, text
from tests.compare import BASE, check

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(text.ORACLE))
def test_text_query(spark, name):
    check(spark, text, name)


@pytest.mark.parametrize("name", sorted(general.ORACLE))
def test_general_query(spark, name):
    check(spark, general, name)


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_fixture_query(spark, name):
    check(spark, fixtures, name)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    core = {**text.QUERIES, **general.QUERIES}.keys() - text.ORACLE.keys() - general.ORACLE.keys()
    assert core <= {"precomputed_terms"}  # see test_engines.py
