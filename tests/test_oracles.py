"""Every registered query of the library against its SQL on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from loreloom.plans import ORACLES, QUERIES
from tests.oracle_compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith("ok"), outcome


def test_library_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "ordinal", "rank", "matched", "score"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
