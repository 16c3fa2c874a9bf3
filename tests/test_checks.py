"""Every registered query against its SQL text, whole results, at sf0.01."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry_point  # noqa: E402
import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, con, name):
    verdict, _, rows = compare.differences(spark, con, FOLDER, name)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
