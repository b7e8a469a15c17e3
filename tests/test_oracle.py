"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import pytest

from compare import check, connect
from fungo import catalog

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, con, name):
    state, note, _ = check(spark, con, name, SF)
    assert state == "ok", note


def test_names_and_columns(spark):
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
