"""Every catalogue query against its SQL statement, on the smallest tables."""

import pytest

from compare import mismatch, oracle
from tablemend.plans.catalog import QUERIES
from tablemend.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert mismatch(QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()) is None


def test_stream_links_every_record_once(spark, sf):
    rows = QUERIES["stream_link"](spark, sf).collect()
    assert len({r.row_id for r in rows}) == len(rows) == 150
    assert all(r.entity_id for r in rows)
