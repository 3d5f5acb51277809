"""Registered queries beside their SQL at sf0.001.

A sample runs by default; ORACLE_ALL=1 runs every query.
"""

import os
import pathlib

import pytest

from codicil.catalog.base import ORACLES, QUERIES, load_all
from tests import oracle

load_all()
SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES) if os.environ.get("ORACLE_ALL") else sorted(ORACLES)[::4]


@pytest.fixture(scope="module")
def con():
    if not pathlib.Path(SF).exists():
        pytest.skip("no driver tables")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message, _ = oracle.compare(spark, SF, con, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_every_query_is_exposed():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
