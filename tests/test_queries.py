import os
import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")

# Queries of the training-data operators are tested in their own folder.
OPTIONAL = re.compile(r"op\d+_|pipeline$")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert {q for q in entry.queries() if not OPTIONAL.match(q)} <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(q for q in entry.oracle_sql() if not OPTIONAL.match(q)))
def test_matches_statement(spark, con, name):
    assert compare(name, entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_window_classifier_query(spark):
    df = entry.queries()["window_classify"](spark, SF_DIR)
    assert df.columns == ["doc_id", "sent_id", "grp", "window_text"] and df.count() > 0


def test_entry(spark):
    assert "score" in entry.entry(spark).columns
